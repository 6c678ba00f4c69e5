import json

import pytest
from pyspark.sql import functions as F

from kvartal.operators import causal, resolve
from kvartal.operators.tessellation import HexGrid
from kvartal.plans.pipeline import run
from kvartal.schema import validate_listings
from kvartal.sources.generator import Truth, generate_listings
from kvartal.streaming.panel_stream import windowed_cells


@pytest.fixture(scope="module")
def generated(spark, tmp_path_factory):
    listings, truth = generate_listings(spark, Truth(per_month=90, start="2024-06", end="2026-08", opening_effect=0.3))
    path = str(tmp_path_factory.mktemp("gen"))
    listings.write.parquet(path + "/l")
    truth.write.parquet(path + "/t")
    return spark.read.parquet(path + "/l"), spark.read.parquet(path + "/t")


def test_generated_rows_keep_the_contract_and_repeat(spark, generated):
    listings, truth = generated
    validate_listings(listings)
    again = generate_listings(spark, Truth(per_month=90, start="2024-06", end="2026-08", opening_effect=0.3))[0]
    mark = lambda d: d.agg(F.sum(F.xxhash64("listing_id", "price_azn_m2", "lat") % 1_000_003)).first()[0]
    assert mark(listings) == mark(again.repartition(7)) and 0.03 < truth.count() / listings.count() < 0.09


def test_planted_duplicates_are_found(generated):
    listings, truth = generated
    pairs = resolve.duplicate_pairs(listings)
    want = truth.select(F.least("listing_id", "original").alias("a"), F.greatest("listing_id", "original").alias("b"))
    found = pairs.join(want, (F.col("listing_id_a") == F.col("a")) & (F.col("listing_id_b") == F.col("b"))).count()
    assert found >= 0.9 * truth.count() and pairs.count() - found <= 0.02 * listings.count()


def test_planted_effect_is_recovered(generated):
    listings, _ = generated
    grid = HexGrid()
    frame = causal.did_frame(listings.withColumn("cell", grid.cell(F.col("lat"), F.col("lon"))), radius_km=1.0)
    row = causal.spatial_did(frame).first()
    assert row["att_log"] == pytest.approx(0.27, abs=0.13) and row["p_value"] < 0.05


def test_whole_run(spark, generated, tmp_path):
    listings, _ = generated
    metrics = run(listings, str(tmp_path), target=140, min_train=14, calibrate=4, hold_out=2, zones=6, splits=2, maxIter=8, maxDepth=4)
    assert metrics["n_duplicates"] > 50 and metrics["feature_rows"] > 100 and metrics["walk_forward"]["mae"] < 2 * metrics["walk_forward"]["naive_mae"]
    p = spark.read.parquet(str(tmp_path / "predictions.parquet"))
    assert p.select("scenario", "horizon_months").distinct().count() == 6 and p.where("q10 > q50 or q50 > q90 or hotspot_prob < 0 or hotspot_prob > 1").count() == 0
    assert json.loads((tmp_path / "metrics.json").read_text())["panel_rows"] == metrics["panel_rows"]


def test_stream_counts(spark, tmp_path):
    rows = spark.range(60).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("ts"), F.concat(F.lit("c"), F.col("id") % 2).alias("h3"), F.col("id").cast("double").alias("price_azn_m2"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_cells(stream).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n_listings) from cells").first()[0] == 60


def test_evaluation_of_a_unit(spark, generated):
    from kvartal.operators.graph import restrict
    from kvartal.operators.study import evaluate_unit

    listings, _ = generated
    grid = HexGrid(edge_km=6.0)
    rows = listings.withColumn("h3", grid.cell(F.col("lat"), F.col("lon")))
    cells = rows.select("h3").distinct()
    lat, lon = grid.centroid(F.col("h3"))
    centres = cells.select("h3", lat.alias("lat"), lon.alias("lon"))
    got = evaluate_unit("hex6", rows, centres, restrict(grid.neighbours(cells), cells), grid.block(F.col("h3")), splits=1, maxIter=2, maxDepth=3).first()
    assert got["name"] == "hex6" and got["n_cells"] > 5 and 0 < got["retained_pct"] <= 100 and got["wf_skill"] < 1 and got["skill"] < 1
