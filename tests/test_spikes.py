import numpy as np
import pandas as pd
import pytest

from kvartal.operators.quantiles import exact_group_median
from kvartal.operators.spikes import constant_runs, implausible_readings, robust_components

SCHEMA = "row_no long, source string, h3 string, updated_at string, price_azn_m2 double, area double, value string, median double"


def brute(rows, limits):
    d = pd.DataFrame(rows, columns=["row_no", "source", "h3", "updated_at", "price_azn_m2", "area", "value", "median"]).sort_values("row_no")
    out = set()
    for field, ratio in limits.items():
        s = d[d[field].notna()]
        med = s.fillna({"h3": ""}).groupby("h3")[field].transform("median")
        bad = (s[field] <= 0) | (s[field] <= med / ratio) | (s[field] >= med * ratio)
        out |= {(r, field) for r in s[bad].row_no}
        for _, g in s.fillna({"h3": "", "source": ""}).groupby(["source", "h3"]):
            v = g[field].to_numpy()
            run = np.cumsum(np.r_[True, v[1:] != v[:-1]])
            n = pd.Series(run).map(pd.Series(run).value_counts()).to_numpy()
            out |= {(r, field) for r in g.row_no[n >= 6]}
    return out


def rows(n=900):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        price, area = float(np.round(1500 * np.exp(rng.normal(0, 0.3)), 1)), float(np.round(80 * np.exp(rng.normal(0, 0.4)), 1))
        if rng.random() < 0.03:
            price = float(rng.choice([0.0, -5.0, price * 10, price / 9]))
        if 300 <= i < 420:
            area = 77.0  # a feed that keeps repeating, over several blocks
        h3 = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"c{i % 4}")
        out.append((i, None if i % 40 == 2 else f"s{i % 2}", h3, [f"2024-01-{1 + i % 28:02d}T10:00:00+04:00", None, "nonsense", "1704110400"][i % 4], None if i % 11 == 0 else price, None if i % 13 == 0 else area, "clash", None))
    return out


def test_matches_brute_force(spark):
    data, limits = rows(), {"price_azn_m2": 2.0, "area": 4.0}
    got = [(r["row_no"], r["field_name"]) for r in implausible_readings(spark.createDataFrame(data, SCHEMA), limits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, limits)


def test_runs_over_blocks(spark):
    values = [1.0] * 5 + [2.0] * 7 + [3.0] + [2.0] * 30 + [4.0, 4.0]
    df = spark.createDataFrame([(i, "s", "c", "f", v) for i, v in enumerate(values)], "row_no long, source string, cell string, field_name string, value double")
    want = {i for i in range(5, 12)} | {i for i in range(13, 43)}
    for block in (1000, 4, 1, 7):
        assert {r["row_no"] for r in constant_runs(df, 6, block).collect()} == want, block


def test_empty_and_all_missing(spark):
    assert implausible_readings(spark.createDataFrame([], SCHEMA), {"area": 4.0}).count() == 0
    one = spark.createDataFrame([(1, "s", "c", None, None, float("nan"), None, None)], SCHEMA)
    assert implausible_readings(one, {"area": 4.0, "price_azn_m2": 2.0}).count() == 0


def test_components_separate_spikes():
    rng = np.random.default_rng(2)
    low = rng.normal(size=(60, 1)) @ rng.normal(size=(1, 20)) + 7
    data = low + rng.normal(0, 0.01, low.shape)
    spikes = rng.random(low.shape) < 0.03
    data[spikes] += 4
    centre, u, v, sparse = robust_components(data, np.ones(low.shape, dtype=bool))
    assert ((sparse > 2) == spikes).mean() > 0.99
    assert np.abs(centre + u @ v.T - low)[~spikes].max() < 0.5


@pytest.mark.parametrize("bins", [1, 64, 1 << 16])
def test_exact_median(spark, bins):
    rng = np.random.default_rng(bins)
    d = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 500, p=[0.7, 0.2, 0.1]), "v": np.round(rng.normal(0, 50, 500), 0)})
    d.loc[:3, "v"] = None
    got = {r["k"]: r["median"] for r in exact_group_median(spark.createDataFrame(d), ["k"], "v", bins).collect()}
    assert got == d.groupby("k")["v"].median().to_dict()


def test_components_choose_what_is_held_against_medians(spark, monkeypatch):
    from kvartal.operators import spikes
    from kvartal.sources.tables import stored

    rng = np.random.default_rng(8)
    data = []
    for i in range(6000):
        price = float(1500 * np.exp(rng.normal(0, 0.1))) * (8 if rng.random() < 0.01 else 1)
        data.append((i, f"s{i % 2}", f"c{i % 10}", f"2024-{1 + i % 12:02d}-{1 + i % 27:02d}T10:00:00+04:00", price, None, None, None))
    df, limits = spark.createDataFrame(data, SCHEMA), {"price_azn_m2": 2.0}
    want = brute(data, limits)
    kept = []
    real = spikes.spiked_days
    monkeypatch.setattr(spikes, "spiked_days", lambda *a: kept.append(stored(real(*a), "days")) or kept[-1])
    assert {(r["row_no"], r["field_name"]) for r in implausible_readings(df, limits).collect()} == want and want
    long = spikes._long(df, ["price_azn_m2"], "h3")
    held = long.join(kept[0], ["source", "field_name", "day", "cell"], "left_semi").count()
    assert len(want) <= held < 0.1 * len(data)
    monkeypatch.setattr(spikes, "daily_profiles", lambda long: spark.createDataFrame([], "source string, field_name string, day int, cell string, low double, high double, usual double"))
    assert implausible_readings(df, limits).count() == 0


def test_cells_whose_median_is_not_positive(spark):
    data = [(i, "s", "c", None, float(v), None, None, None) for i, v in enumerate([-5, -4, -3, 0, 0, 2, 9])]
    got = {r["row_no"] for r in implausible_readings(spark.createDataFrame(data, SCHEMA), {"price_azn_m2": 2.0}).collect()}
    assert got == {r for r, _ in brute(data, {"price_azn_m2": 2.0})}
