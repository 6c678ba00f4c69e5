import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.operators import cross_section, serving, study
from kvartal.sources import generator, nodes


@pytest.fixture(scope="module")
def listings(spark):
    rows, _ = generator.generate_listings(spark, generator.Truth(per_month=40))
    return rows.withColumn("h3", F.concat(F.lit("c"), F.floor(F.col("lon") * 12).cast("string"), F.lit(":"), F.floor(F.col("lat") * 12).cast("string"))).cache()


def test_listing_models(spark, listings):
    centres = listings.groupBy("h3").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).cache()
    pair = centres.select("h3", F.split(F.expr("substring(h3, 2)"), ":").alias("p")).select("h3", F.col("p")[0].cast("int").alias("i"), F.col("p")[1].cast("int").alias("j"))
    a, b = pair.select(F.col("h3").alias("src"), F.col("i").alias("i1"), F.col("j").alias("j1")), pair.select(F.col("h3").alias("dst"), F.col("i").alias("i2"), F.col("j").alias("j2"))
    edges = a.join(b, F.abs(F.col("i1") - F.col("i2")) + F.abs(F.col("j1") - F.col("j2")) == 1).select("src", "dst")
    rows = cross_section.listing_features(listings, centres, edges, "2026-08").cache()
    assert rows.count() == listings.count() and set(cross_section.FEATURES) <= set(rows.columns)
    d = rows.select("h3", "price_azn_m2", "nbr_price").toPandas()
    med = d.groupby("h3").price_azn_m2.median()
    some = edges.toPandas().groupby("src").dst.apply(list)
    for h3, near in list(some.items())[:5]:
        assert d[d.h3 == h3].nbr_price.iloc[0] == pytest.approx(np.mean([med[n] for n in near]))
    folds = centres.select("h3", (F.pmod(F.xxhash64("h3"), F.lit(3))).cast("int").alias("fold"))
    tiny = folds.withColumn("fold", F.when(F.col("h3") == min(med.index, key=lambda c: (d.h3 == c).sum()), 9).otherwise(F.col("fold")))
    got = cross_section.evaluate_listings(rows, tiny, maxIter=30, maxDepth=4)
    mean = cross_section.mean_of_folds(got).first()
    each = got.toPandas()
    mae = (each.actual - each.prediction).abs().groupby(each["split"]).mean()
    assert mean["mae"] == pytest.approx(mae.mean()) and mean["n_folds"] == len(mae) == 3 and mean["r2"] > 0.2
    cells = cross_section.cell_prices(rows, maxIter=30, maxDepth=4).toPandas()
    assert (cells.q10 <= cells.q50).all() and (cells.q50 <= cells.q90).all() and len(cells) == len(med)


def test_seeded_sample_and_shuffle(spark):
    df = spark.range(500)
    one, two = ([r["id"] for r in cross_section.seeded_sample(d, 50, "id", 3).collect()] for d in (df, df.repartition(7)))
    assert one == two and len(set(one)) == 50 and one != [r["id"] for r in cross_section.seeded_sample(df, 50, "id", 4).collect()]
    assert sorted(r["id"] for r in cross_section.shuffled(df, "id").collect()) == list(range(500))


def test_units_are_made_and_compared(spark, listings):
    flat = listings.drop("h3")
    few = {"hex_4000": ("hex", {"edge_km": 4.0}), "kdtree_n300": ("kdtree", {"target": 300}), "market_k6": ("market", {"regions": 6, "edge_km": 4.0})}
    got = study.compare_units(flat, "2025-06", few, splits=1, maxIter=3, maxDepth=3)
    rows = {r["name"]: r for r in got.collect()}
    assert set(rows) == set(few) and all(r["n_cells"] > 1 and r["retained_pct"] > 30 for r in rows.values())
    assert study.recommended(got) in {*few, None}
    assert len(study.CANDIDATES) == 8
    with pytest.raises(ValueError):
        study.make_unit("squares")


def test_generated_listings_are_saved(spark, tmp_path):
    table, document = generator.save_generated(spark, str(tmp_path), generator.Truth(per_month=5, duplicate_share=0.2))
    truth = json.load(open(document))
    assert truth["n_base_listings"] == 5 * 44 and truth["n_duplicates"] == spark.read.parquet(str(tmp_path / "duplicate_map.parquet")).count() > 0
    assert spark.read.parquet(table).count() == truth["n_base_listings"] + truth["n_duplicates"] and truth["planted"]["per_month"] == 5


def test_fetched_nodes_land_under_the_contract(spark, tmp_path):
    from kvartal.schema import LISTINGS, _names

    node = {"id": "7", "path": "/x/7", "area": {"value": 50.0}, "price": {"total": 100000.0, "currency": "AZN"}, "rooms": 2, "floor": 3, "floors": 9, "hasRepair": True, "location": {"name": "N", "lat": 40.4, "lon": 49.8}, "photos": [], "updatedAt": "2026-08-03T10:00:00Z"}
    pages = {None: {"edges": [{"node": node}, {"node": {**node, "id": "8", "price": None}}], "pageInfo": {"hasNextPage": True, "endCursor": "c"}}, "c": {"edges": [{"node": {**node, "id": "9"}}], "pageInfo": {"hasNextPage": False}}}
    today = F.to_date(F.lit("2026-08-31"))
    path = nodes.fetch_to_parquet(spark, lambda v: (200, {"data": {"items": pages[v["cursor"]]}}), str(tmp_path / "fetched.parquet"), today)
    back = spark.read.parquet(path)
    assert back.columns == _names(LISTINGS) and {r["listing_id"] for r in back.collect()} == {"FEED-7", "FEED-9"}
    empty = nodes.fetch_to_parquet(spark, lambda v: (500, {}), str(tmp_path / "none.parquet"), today)
    assert spark.read.parquet(empty).columns == _names(LISTINGS) and spark.read.parquet(empty).count() == 0
    assert nodes.http_post("http://127.0.0.1:9/none", "query", timeout=1)({}) == (0, {})


def test_facts(spark):
    config = serving.configuration()
    assert config["scenarios"] == ["baseline", "polycentric", "transit"] and len(config["nodes"]) == serving.nodes(spark).count() == 8
    assert serving.stations(spark).where("opened is null").count() == 1 and set(config["metrics"]) == set(serving.METRICS)
