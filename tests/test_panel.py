import pytest
from pyspark.sql import functions as F

from kvartal.functions.moments import moment_us, month_number, month_text
from kvartal.operators import panel as panels
from kvartal.operators.features import feature_matrix
from kvartal.schema import SchemaError, validate_panel

CELLS = [("c0", "2024-01", 100.0), ("c0", "2024-02", 110.0), ("c0", "2024-03", 120.0), ("n1", "2024-01", 200.0), ("n1", "2024-02", 210.0), ("n1", "2024-03", 220.0), ("n2", "2024-01", 300.0), ("n2", "2024-03", 330.0), ("n2", "2024-04", 340.0)]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(c, m, p, p, 5, 0.5) for c, m, p in CELLS], "h3 string, month string, price_azn_m2_median double, price_azn_m2_mean double, n_listings long, new_share double")


@pytest.fixture(scope="module")
def ring(spark):
    return spark.createDataFrame([(a, b) for a in ("c0", "n1", "n2") for b in ("c0", "n1", "n2") if a != b], "src string, dst string")


@pytest.fixture(scope="module")
def middle(spark):
    return spark.createDataFrame([("c0", 40.39, 49.81), ("n1", 40.40, 49.82), ("n2", 40.41, 49.83)], "h3 string, lat double, lon double")


def test_features_by_hand(tiny, ring, middle):
    got = {(r["h3"], r["month"]): (r["lag_own_1m"], r["lag_own_3m"], r["nbr_price_prev_month"], r["month_ix"]) for r in feature_matrix(tiny, middle, ring).collect()}
    assert got == {("c0", "2024-02"): (100, None, 250, 1), ("c0", "2024-03"): (110, None, 210, 2), ("n1", "2024-02"): (200, None, 200, 1), ("n1", "2024-03"): (210, None, 110, 2), ("n2", "2024-04"): (330, 300, 170, 3)}


def test_later_prices_reach_no_earlier_feature(tiny, ring, middle):
    later = tiny.withColumn("price_azn_m2_median", F.when(F.col("month") >= "2024-03", F.col("price_azn_m2_median") * 9).otherwise(F.col("price_azn_m2_median")))
    cols = ["h3", "month", "lag_own_1m", "lag_own_3m", "mom_3m", "nbr_price_prev_month", "new_share_prev_month"]
    early = lambda p: sorted(map(tuple, feature_matrix(p, middle, ring).where("month <= '2024-03'").select(cols).collect()), key=str)
    assert early(tiny) == early(later)


def test_a_lag_below_one_is_refused(tiny, ring):
    with pytest.raises(ValueError):
        panels.target_encoding(tiny, ring, "price_azn_m2_median", "x", 0)


def test_features_are_not_added_twice(tiny, ring, middle):
    with pytest.raises(ValueError):
        feature_matrix(tiny.withColumn("mom_3m", F.lit(1.0)), middle, ring)


def test_dense_panel_and_filling(tiny):
    dense = panels.complete_panel(tiny, panels.month_span(tiny))
    assert dense.count() == 12 and dense.where("n_listings = 0").count() == 3
    filled = {(r["h3"], r["month"]): r["log_filled"] for r in panels.forward_fill_log(dense).collect()}
    import math

    assert filled["n2", "2024-02"] == pytest.approx(math.log(300)) and filled["c0", "2024-04"] == pytest.approx(math.log(120))


def test_panel_contract(tiny):
    assert validate_panel(tiny) is tiny
    with pytest.raises(SchemaError):
        validate_panel(tiny.unionByName(tiny))
    with pytest.raises(SchemaError):
        validate_panel(tiny.drop("new_share"))


def test_empty_panel(tiny):
    none = tiny.limit(0)
    assert panels.complete_panel(none, panels.month_span(none)).count() == 0 and panels.recent_momentum(none).count() == 0


def test_months(spark):
    row = spark.range(1).select(month_number(F.lit("2024-12")).alias("a"), month_text(F.lit(2024 * 12 + 12)).alias("b"), month_text(F.lit(2025 * 12 + 1)).alias("c"), month_number(F.lit("x")).alias("d")).first()
    assert tuple(row) == (2024 * 12 + 12, "2024-12", "2025-01", None)


def test_moments(spark):
    texts = ["2023-01-01T12:08:24+04:00", "2023-01-01T08:08:24Z", "2023-01-01T08:08:24.000Z", "2023-01-01 12:08:24", "1672560504", "01.01.2023 12:08", "", None, "soon", "2023-13-45 00:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", moment_us(F.col("t")).alias("m"))
    got = {r["i"]: r["m"] for r in df.collect()}
    assert [got[i] for i in range(5)] == [1672560504 * 10**6] * 5 and got[5] == 1672560480 * 10**6 and [got[i] for i in range(6, 10)] == [None] * 4
