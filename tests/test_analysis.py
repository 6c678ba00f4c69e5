import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kvartal.functions.numeric import normal_cdf, price_percentile, price_position, signed_percent
from kvartal.functions.parsing import first_integer, first_number, floor_pair, flatten_node, json_list, listed_month, normalise_nodes, path_tail, phash_hamming, positive_number
from kvartal.operators import causal, intervals, resolve, serving, study, validation
from kvartal.operators.forecast import fit_ridge, lag_gaps, ridge_forecast
from kvartal.operators.scenario import opening_ramp, transit_ramp, weighted_slope
from kvartal.sources.nodes import NodePages, fetch_pages
from kvartal.sources.sinks import load_artifacts, plain, write_documents, write_tables


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_numbers(spark):
    texts = ["150 000 AZN", "85,5 m²", "150.000", "1,500,000", "1 250 000", "1.2.3", "", "none", "0", None, "12.5."]
    assert [v for v, _ in values(spark, texts, first_number(F.col("t")), positive_number(F.col("t")))] == [150000, 85.5, 150000, 1500000, 1250000, None, None, None, 0, None, 12.5]
    assert values(spark, ["0"], positive_number(F.col("t"))) == [(None,)]


def test_small_parsers(spark):
    assert [v for (v,) in values(spark, ["Otaq sayı: 3", "x", None], first_integer(F.col("t")))] == [3, None, None]
    assert [tuple(v) for (v,) in values(spark, ["4/9 mərtəbə", "5 mərtəbə", "12 / 17", "-"], floor_pair(F.col("t")))] == [(4, 9), (5, None), (12, 17), (None, None)]
    today = F.to_date(F.lit("2026-03-01"))
    assert [v for (v,) in values(spark, ["28 Avqust 2025", "15 İyun", "Bu gün, 14:32", "DÜNƏN", "yesterday", None], listed_month(F.col("t"), today))] == ["2025-08", "2026-06", "2026-03", "2026-02", None, None]
    assert [v for (v,) in values(spark, ["/items/12/", "/", "", None], path_tail(F.col("t")))] == ["12", "unknown", "unknown", "unknown"]
    assert [v for (v,) in values(spark, ['["a","b"]', "nonsense", None], json_list(F.col("t")))] == [["a", "b"], [], []]


def test_hash_distance(spark):
    pairs = [("ff", "fe", 1), ("0000000000000000", "ffffffffffffffff", 64), ("", "ff", 64), ("-4", "ff", 64), (None, "ff", 64), ("8000000000000000", "0", 1), ("zz", "00", 64)]
    got = spark.createDataFrame(pairs, "a string, b string, want int").select(phash_hamming(F.col("a"), F.col("b")).alias("d"), "want").collect()
    assert all(r["d"] == r["want"] for r in got)


NODES = [
    {"id": "7", "path": "/items/7", "area": {"value": 50.0}, "price": {"total": 100000.0, "currency": "AZN"}, "rooms": 2, "floor": 3, "floors": 9, "hasRepair": True, "location": {"name": "A", "lat": 40.4, "lon": 49.8}, "photos": [{"large": "L", "thumbnail": "T"}, {"large": "", "thumbnail": "t2"}], "updatedAt": "2026-02-03T00:00:00Z"},
    {"id": None, "path": "/items/8/", "area": {"value": 33.0}, "price": {"total": 50000.0}, "location": {"lat": 40.4, "lon": 49.8}, "photos": None},
    {"id": "9", "area": None, "price": {"total": 1.0}}, {"id": "10", "area": {"value": 10.0}, "price": {"total": 0.0}, "location": {"lat": 1.0, "lon": 1.0}},
]


def test_nodes(spark, tmp_path):
    from kvartal.sources.nodes import read_nodes

    (tmp_path / "n.json").write_text("\n".join(json.dumps(n) for n in NODES))
    rows = normalise_nodes(flatten_node(read_nodes(spark, str(tmp_path / "n.json"))), F.to_date(F.lit("2026-08-31"))).orderBy("listing_id").collect()
    assert [(r["listing_id"], r["price_azn_m2"], r["building_type"], r["listed_month"], r["photo_urls"], r["rooms"]) for r in rows] == [("FEED-7", 2000.0, "new", "2026-02", '["L","t2"]', 2), ("FEED-8", 1515.2, "old", "2026-08", "[]", 0)]
    body = lambda nodes, more, cursor: {"data": {"items": {"edges": [{"node": n} for n in nodes], "pageInfo": {"hasNextPage": more, "endCursor": cursor}}}}
    replies = [(200, body(NODES[:2], True, "c1")), (200, body(NODES[2:], False, None)), (500, {})]
    asked = []
    assert len(list(fetch_pages(lambda v: asked.append(v) or replies[len(asked) - 1], 5, 99))) == 4 and asked[0]["first"] == 50 and asked[1]["cursor"] == "c1"
    assert list(fetch_pages(lambda v: (200, {"errors": ["x"]}))) == []
    (tmp_path / "pages.jsonl").write_text("\n".join(json.dumps(r[1]) for r in replies))
    spark.dataSource.register(NodePages)
    assert spark.read.format("node_pages").load(str(tmp_path / "pages.jsonl")).count() == 4


def test_normal_and_labels(spark):
    xs = [-4.0, -1.0, 0.0, 0.3, 2.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p"), signed_percent(F.col("x")).alias("s")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 2e-7 for r in got) and got[3]["s"] == "+0.3%"
    rows = spark.createDataFrame([(90.0, 100.0, 200.0, 150.0), (210.0, 100.0, 200.0, 150.0), (120.0, 100.0, 200.0, None), (160.0, 100.0, 200.0, 150.0), (0.0, 100.0, 200.0, 150.0), (5.0, None, 200.0, 150.0)], "p double, a double, z double, m double")
    got = rows.select(price_position(F.col("p"), F.col("a"), F.col("z"), F.col("m")).alias("w"), price_percentile(F.col("p"), F.col("a"), F.col("z")).alias("c")).collect()
    assert [r["w"] for r in got] == ["underpriced", "overpriced", "below average", "above average", "unknown", "unknown"] and [r["c"] for r in got] == [0, 100, 20, 60, 50, 50]


def test_splits_and_folds(spark):
    months = [f"{2023 + m // 12}-{m % 12 + 1:02d}" for m in range(30)]
    splits = validation.walk_forward_splits(months, 18, 2, 5)
    assert all(max(a) < min(b) for a, b in splits) and splits[-1][1][-1] == months[-1] and splits[0][0] == months[:18]
    with pytest.raises(ValueError):
        validation.walk_forward_splits(months[:18])
    cells = spark.createDataFrame([(f"kd:{i:06b}",) for i in range(48)], "h3 string")
    folds = validation.block_folds(cells, F.substring("h3", 4, 3), 3).withColumn("block", F.substring("h3", 4, 3))
    assert folds.groupBy("block").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0 and {r["count"] for r in folds.groupBy("fold").count().collect()} == {16}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 10.0, 12.0), (1, 0.0, 1.0), (1, 20.0, 18.0), (2, 5.0, float("nan")), (2, 5.0, 5.0), (2, None, 1.0)], "s int, y double, p double")
    got = {r["s"]: r for r in validation.pooled_and_split(df, "y", "p", "s").collect()}
    y, p = np.array([10.0, 0, 20, 5]), np.array([12.0, 1, 18, 5])
    assert got[None]["n"] == 4 and got[None]["mae"] == pytest.approx(np.abs(y - p).mean()) and got[None]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got[1]["mape"] == pytest.approx(15.0) and got[2]["r2"] is None


def test_intervals(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(0, 1, 300)
    df = spark.createDataFrame([(float(v),) for v in y], "y double").withColumn("lo", F.lit(-0.5)).withColumn("hi", F.lit(0.5))
    scores = np.sort(np.maximum(-0.5 - y, y - 0.5))
    row = intervals.conformal_offset(df, "y", "lo", "hi").first()
    assert row["offset"] == pytest.approx(scores[math.ceil(301 * 0.8) - 1]) and row["n"] == 300
    wide = df.select("y", *intervals.widen(F.col("lo"), F.lit(0.0), F.col("hi"), F.lit(row["offset"])))
    assert 0.79 <= intervals.coverage(wide, "y", "q10", "q90").first()["coverage"] <= 0.83
    assert intervals.conformal_offset(df.limit(0), "y", "lo", "hi").count() == 0
    with pytest.raises(ValueError):
        intervals.check_windows(["2024-02"], ["2024-02"])


def test_fixed_effects_equal_dense_least_squares(spark):
    rng = np.random.default_rng(7)
    n = 600
    d = pd.DataFrame({"cell": rng.choice([f"c{i}" for i in range(20)], n), "listed_month": rng.choice([f"2024-{m:02d}" for m in range(1, 10)], n), "x": rng.normal(size=n), "t": rng.integers(0, 2, n).astype(float)})
    d["y"] = 0.3 * d.t + 0.1 * d.x + d.cell.str[1:].astype(int) * 0.05 + d.listed_month.str[5:].astype(int) * 0.02 + rng.normal(0, 0.2, n)
    est = causal.fixed_effects_ols(spark.createDataFrame(d), "y", ["t"], ["x"])
    design = np.column_stack([d.t, d.x, pd.get_dummies(d.listed_month).to_numpy(float), pd.get_dummies(d.cell).to_numpy(float)[:, 1:]])
    inv = np.linalg.pinv(design.T @ design)
    beta = inv @ design.T @ d.y
    e = d.y - design @ beta
    meat = sum(np.outer(s, s) for s in (design[d.cell == c].T @ e[d.cell == c] for c in d.cell.unique()))
    k = np.linalg.matrix_rank(design)
    cov = 20 / 19 * (n - 1) / (n - k) * inv @ meat @ inv
    assert est.rank == k and est.coef["t"] == pytest.approx(beta[0]) and est.se["t"] == pytest.approx(math.sqrt(cov[0, 0]))


def test_duplicates_by_hash_or_text(spark):
    base = {"lat": 40.4, "lon": 49.8, "rooms": 2, "floor": 3, "building_floors": 9, "area_m2": 60.0, "price_azn_m2": 2000.0, "listed_month": "2024-01", "image_phash": "ff00ff00ff00ff00", "description": "a quiet flat with a view of the sea"}
    rows = [{**base, "listing_id": "A"}, {**base, "listing_id": "B", "image_phash": "ff00ff00ff00ff01", "listed_month": "2023-12"}, {**base, "listing_id": "C", "image_phash": "", "lat": 40.4015}, {**base, "listing_id": "D", "image_phash": "", "description": "entirely other words here"}, {**base, "listing_id": "E", "lat": 40.41}, {**base, "listing_id": "F", "floor": 4}, {**base, "listing_id": "G", "lat": None}]
    df = spark.createDataFrame(pd.DataFrame(rows))
    pairs = resolve.duplicate_pairs(df)
    assert {(r["listing_id_a"], r["listing_id_b"]) for r in pairs.collect()} == {("A", "B"), ("A", "C"), ("B", "C")}
    clean, mapping = resolve.without_duplicates(df, pairs)
    assert {tuple(r) for r in mapping.collect()} == {("A", "B"), ("C", "B")} and clean.count() == 5
    assert resolve.candidate_pairs(df.limit(0)).count() == 0


def test_ridge_and_rollout(spark):
    rng = np.random.default_rng(2)
    months = [f"2024-{m:02d}" for m in range(1, 13)]
    rows = [(f"c{i}", m, float(7 + 0.1 * i + 0.01 * t + rng.normal(0, 0.002)), True) for i in range(6) for t, m in enumerate(months)]
    filled = spark.createDataFrame([(c, m, v, v, o) for c, m, v, o in rows], "h3 string, month string, log_obs double, log_filled double, observed boolean")
    weights = spark.createDataFrame([(f"c{i}", f"c{(i + 1) % 5}", 1.0) for i in range(5)], "src string, dst string, weight double")
    drift, beta = fit_ridge(lag_gaps(filled, weights))
    assert drift == pytest.approx(0.01, abs=0.003) and beta.shape == (5,)
    out = ridge_forecast(filled, weights, (1, 12)).collect()
    assert len(out) == 12 and all(0.98 < r["y_pred"] / math.exp(7 + 0.1 * int(r["h3"][1]) + 0.01 * (11 + r["horizon_months"])) < 1.05 for r in out)
    with pytest.raises(ValueError):
        ridge_forecast(filled, weights, ())


def test_slopes_and_ramps(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 3.0, 1.0), (4.0, 9.0, 2.0)], "x double, y double, w double")
    assert weighted_slope(df, "y", "x", "w").first()["slope"] == pytest.approx(np.polyfit([1, 2, 4], [2, 3, 9], 1, w=np.sqrt([3, 1, 2]))[0])
    row = spark.range(1).select(*[transit_ramp(F.lit(h)).alias(f"h{h}") for h in (3, 7, 12)], *[opening_ramp(F.lit(k)).alias(f"r{k + 9}") for k in (-1, 0, 5)]).first()
    assert tuple(row) == pytest.approx((0, 1 / 3, 1, 0, 1 / 3, 1))


def test_search_page_and_facets(spark):
    rows = [(f"L{i}", "A" if i % 2 else "", 2, "new", None if i == 0 else 1000.0 * i, 50.0, 10.0 * i, "2024-01") for i in range(7)]
    df = spark.createDataFrame(rows, "listing_id string, district string, rooms long, building_type string, price_azn double, area_m2 double, price_azn_m2 double, listed_month string")
    assert serving.search(df, price_max=2000).count() == 3 and serving.search(df, district="A", price_min=2000).count() == 2
    got = serving.page(df, "price_desc", 9, 3).collect()
    assert [r["listing_id"] for r in got] == ["L0"] and got[0]["page"] == 3 and got[0]["total"] == 7
    with pytest.raises(ValueError):
        serving.page(df, per_page=0)
    f = serving.facets(df).first()
    assert f["districts"] == ["A"] and f["price_azn_max"] == 6000 and serving.facets(df.limit(0)).first()["price_azn_min"] == 0


def test_study(spark):
    df = spark.createDataFrame([("kd70", 46.1, 9.0, 0.189), ("kd140", 81.6, 26.0, 0.174), ("hex8", 62.6, 5.0, 0.139), ("hex9", 80.0, 13.0, -0.3), ("one", 90.0, 40.0, 0.1)], "name string, retained_pct double, median_months double, skill double")
    assert [r["name"] for r in study.viable(df).collect()] == ["kd140", "one", "hex9"]
    assert {r["family"]: r["sign_flips"] for r in study.family_stability(df).collect()} == {"kd": False, "hex": True}


def test_artifacts(spark, tmp_path):
    write_tables(str(tmp_path), {"panel": spark.range(3)})
    write_documents(spark, str(tmp_path), {"metrics": {"a": float("nan"), 1: np.float64(2), "r": spark.range(1).first()}})
    got = load_artifacts(spark, str(tmp_path), ["panel", "metrics", "absent"])
    assert got["panel"].count() == 3 and got["metrics"] == {"a": None, "1": 2.0, "r": {"id": 0}} and "absent" not in got and plain([float("inf")]) == [None]


def test_work_tables_are_released(spark, tmp_path):
    import os

    from kvartal.sources.tables import _made, first_existing, release, stored

    kept = _made.pop(spark.sparkContext.applicationId, [])
    assert stored(spark.range(5), "x").count() == 5
    path = _made[spark.sparkContext.applicationId][0].removeprefix("file://")
    assert os.path.isdir(path) and release(spark) == 1 and not os.path.exists(path) and release(spark) == 0
    _made[spark.sparkContext.applicationId] = kept
    assert first_existing(spark, [str(tmp_path / "none.parquet")], "a int").columns == ["a"]
