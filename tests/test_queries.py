import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n in sorted(QUERIES) if not n.startswith(("p3", "p4", "p6", "p7", "p8", "p9"))]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (bool, str)):
            return v
        if hasattr(v, "__len__"):
            return [cell(x) for x in v]
        return round(float(v), 6) + 0.0

    return sorted(str([cell(v) for v in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["p2_found", "block_folds", "cells_geojson", "kd_fit", "enrich_listings"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["row_no", "target_id"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_duplicate_map_links_by_text_too(spark, tmp_path):
    flat = {"source": "s", "h3": "c", "listed_month": "2024-01", "price_azn_m2": 2000.0, "area": 60.0, "lat": 40.4, "lon": 49.8, "rooms": 2, "floor": 3, "floors": 9, "building_type": "new", "image_phash": "", "location_name": "x"}
    marks = {"A": "", "B": None, "C": "ff00ff00ff00ff00", "D": "ff00ff00ff00ff01", "E": ""}
    rows = [{**flat, "row_no": i, "listing_id": k, "image_phash": v} for i, (k, v) in enumerate(marks.items())]
    spark.createDataFrame(pd.DataFrame(rows).astype({"image_phash": object})).write.parquet(str(tmp_path / "listings.parquet"))
    texts = [(1, "A", "a quiet flat with a view of the sea"), (2, "B", "a quiet flat with a view of the sea"), (3, "D", "A quiet flat with a view"), (4, "D", "of the sea"), (5, "E", "entirely other words here"), (6, None, "a quiet flat")]
    spark.createDataFrame(texts, "doc_id long, listing_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in QUERIES["duplicate_map"](spark, str(tmp_path)).collect()} == {("B", "A"), ("C", "A"), ("D", "A")}


def test_trees_walk_over_all_months(spark, monkeypatch):
    from kvartal.operators import models, validation

    calls = []
    monkeypatch.setattr(models, "evaluate_walk_forward", lambda df, features, target, splits, **trees: calls.append((df, splits, trees)) or df)
    QUERIES["tree_predictions"](spark, DATA)
    df, splits, trees = calls[0]
    months = sorted(r["month"] for r in df.select("month").distinct().collect())
    assert splits == validation.walk_forward_splits(months) and [m for _, test in splits for m in test] == months[18:]
    assert {**models.TREES, **trees} == {"maxIter": 600, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
