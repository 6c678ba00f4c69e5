import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.constants import LAND
from kvartal.operators.features import cells_geojson
from kvartal.operators.outlines import _area, dissolve, dissolved, nearest_polygon, stored_polygons, subset_polygons
from kvartal.sources.sinks import read_collection, write_collection

BOX = "h3 string, lat_min double, lat_max double, lon_min double, lon_max double"


def square(x, y, w=1.0, h=1.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_dissolve_joins_what_touches():
    assert dissolve([square(0, 0), square(1, 0)]) == [[(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)]]
    assert dissolve([square(0, 0, 2, 2), square(2, 0), square(2, 1)]) == [[(0, 0), (3, 0), (3, 2), (0, 2), (0, 0)]]
    ring = dissolve([square(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)])
    assert sorted(map(_area, ring)) == [-1.0, 9.0]
    assert sorted(map(_area, dissolve([square(0, 0), square(1, 1)]))) == [1.0, 1.0]
    assert sorted(map(_area, dissolve([square(0, 0), square(5, 5)[::-1]]))) == [1.0, 1.0]
    assert dissolve([]) == [] and dissolve([[(0, 0), (1, 1)]]) == []


def test_dissolve_keeps_the_area_of_random_cuts():
    rng = np.random.default_rng(1)
    boxes = [(0.0, 0.0, 8.0, 8.0)]
    for _ in range(30):
        x, y, w, h = boxes.pop(rng.integers(len(boxes)))
        cut = float(rng.uniform(0.2, 0.8))
        boxes += [(x, y, w * cut, h), (x + w * cut, y, w - w * cut, h)] if rng.random() < 0.5 else [(x, y, w, h * cut), (x, y + h * cut, w, h - h * cut)]
    assert dissolve([square(*b) for b in boxes]) == [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)]]
    some = boxes[::2]
    assert sum(map(_area, dissolve([square(*b) for b in some]))) == pytest.approx(sum(w * h for *_, w, h in some), abs=1e-6)


def boxes(spark):
    return spark.createDataFrame([("a", 40.30, 40.35, 49.80, 49.85), ("b", 40.35, 40.40, 49.80, 49.85), ("c", 40.30, 40.40, 49.85, 49.90), ("sea", 40.0, 40.1, 50.5, 50.6)], BOX)


def test_zones_collections_and_subsets(spark, tmp_path):
    cells = cells_geojson(boxes(spark))
    zones = spark.createDataFrame([("a", 1, "Zone 1"), ("b", 1, "Zone 1"), ("c", 2, "Zone 2")], "h3 string, zone long, zone_name string")
    out = {r["zone"]: json.loads(r["feature"]) for r in dissolved(cells.join(zones, "h3"), "zone", ["zone_name"]).collect()}
    assert out[1]["properties"] == {"zone": 1, "zone_name": "Zone 1", "n_cells": 2} and out[1]["geometry"]["type"] == "Polygon"
    assert _area(out[1]["geometry"]["coordinates"][0]) == pytest.approx(0.05 * 0.1)
    path = str(tmp_path / "cells.geojson")
    write_collection(cells, path)
    assert len(json.load(open(path))["features"]) == 3
    back = read_collection(spark, path)
    assert {r["h3"] for r in stored_polygons(back).collect()} == {"a", "b", "c"}
    wanted = spark.createDataFrame([("a", 7.5), ("gone", 1.0)], "h3 string, price double")
    one = [json.loads(r["feature"]) for r in subset_polygons(back, wanted).collect()]
    assert len(one) == 1 and one[0]["id"] == "a" and one[0]["properties"] == {"h3": "a", "price": 7.5}
    bad = spark.createDataFrame([("{}",), ("no json",), ('{"id": "p", "geometry": {"type": "Point", "coordinates": [[[1.0, 2.0]]]}}',), (None,)], "feature string")
    assert stored_polygons(bad).count() == 0
    write_collection(cells.limit(0), path)
    assert read_collection(spark, path).count() == 0
    assert len(LAND) > 10


def test_nearest_polygon(spark, monkeypatch):
    from kvartal.operators import outlines

    cells = cells_geojson(boxes(spark), clip=False)
    points = [(1, 40.31, 49.81), (2, 40.36, 49.81), (3, 40.2, 49.88), (4, 40.05, 51.0), (5, None, 49.0), (6, 40.35, 49.82), (7, float("nan"), 1.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    want = {1: "a", 2: "b", 3: "c", 4: "sea", 6: "a"}
    assert {r["id"]: r["h3"] for r in nearest_polygon(df, "id", "lat", "lon", cells).collect()} == want
    monkeypatch.setattr(outlines, "POLYGONS_AT_ONCE", 2)
    assert {r["id"]: r["h3"] for r in nearest_polygon(df, "id", "lat", "lon", cells).collect()} == want
    assert nearest_polygon(df, "id", "lat", "lon", cells.where(F.lit(False))).count() == 0
