import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.operators.clustering import share_out, ward_labels
from kvartal.operators.components import connected_components
from kvartal.operators.features import cells_geojson, clip_ring, on_land
from kvartal.operators.graph import box_edges, k_ring, neighbour_weights, normalised_adjacency
from kvartal.operators.tessellation import HexGrid, KM_PER_DEGREE, assign_boxes, fit_kd


def plain_kd(y, x, target, span):
    out = {}

    def split(path, y0, y1, x0, x1, ys, xs):
        high, wide = (y1 - y0) * KM_PER_DEGREE * 1000, (x1 - x0) * KM_PER_DEGREE * 1000 * math.cos(math.radians((y0 + y1) / 2))
        n = len(ys)
        if not abs(n / 2 - target) < abs(n - target) or min(high, wide) < span:
            out["kd:" + (path or "r")] = (y0, y1, x0, x1, n)
            return
        v, a, b = (ys, y0, y1) if high >= wide else (xs, x0, x1)
        cut = float(np.median(v))
        cut = cut if a < cut < b else (a + b) / 2
        m = v <= cut
        for bit, k in (("0", m), ("1", ~m)):
            box = [y0, y1, x0, x1]
            i = (0 if high >= wide else 2) + (bit == "0")
            box[i] = cut
            split(path + bit, *box, ys[k], xs[k])

    split("", y.min() - 1e-6, y.max() + 1e-6, x.min() - 1e-6, x.max() + 1e-6, y, x)
    return out


def test_kd_boxes_equal_the_recursion(spark):
    rng = np.random.default_rng(4)
    y, x = np.round(rng.normal(40.4, 0.05, 700), 6), np.round(rng.normal(49.85, 0.08, 700), 6)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))] + [(-1, None, 49.0), (-2, float("nan"), 49.0)], "id long, lat double, lon double")
    boxes = fit_kd(points, "lat", "lon", target=90).leaves
    got = {r["h3"]: (r["lat_min"], r["lat_max"], r["lon_min"], r["lon_max"], r["n"]) for r in boxes.collect()}
    want = plain_kd(y, x, 90, 250.0)
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c]) for c in got)
    cells = {r["id"]: r["cell"] for r in assign_boxes(points, "id", "lat", "lon", boxes).collect()}
    assert len(cells) == 700 and all(got[c][0] <= y[i] <= got[c][1] and got[c][2] <= x[i] <= got[c][3] for i, c in cells.items())
    edges = {(r["src"], r["dst"]) for r in box_edges(boxes).collect()}
    touching = set()
    for a, p in got.items():
        for b, q in got.items():
            v, h = min(p[1], q[1]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[2], q[2])
            if a != b and ((v > 1e-9 and abs(h) <= 1e-9) or (h > 1e-9 and abs(v) <= 1e-9)):
                touching.add((a, b))
    assert edges == touching and {(b, a) for a, b in edges} == edges


def test_fit_without_points_fails(spark):
    with pytest.raises(ValueError):
        fit_kd(spark.createDataFrame([(None, None)], "lat double, lon double"), "lat", "lon")


def test_hexagons(spark):
    grid = HexGrid()
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.uniform([40.3, 49.6], [40.5, 50.0], (200, 2))], "lat double, lon double").withColumn("h3", grid.cell(F.col("lat"), F.col("lon")))
    lat, lon = grid.centroid(F.col("h3"))
    rows = df.select("h3", grid.cell(lat, lon).alias("again"), grid.block(F.col("h3")).alias("block"), (F.hypot((F.col("lat") - lat) * 111.2, (F.col("lon") - lon) * 84.7)).alias("d"), F.size(grid.boundary(F.col("h3"))).alias("k")).collect()
    assert all(r["h3"] == r["again"] and r["d"] <= 0.54 and r["k"] == 6 for r in rows)
    assert len({r["block"] for r in rows}) < len({r["h3"] for r in rows})
    for k in (1, 2):
        near = grid.neighbours(df, k).groupBy("src").count().select("count").distinct().collect()
        assert [r[0] for r in near] == [3 * k * (k + 1)]


def test_rings_and_weights(spark):
    line = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")], "src string, dst string")
    assert {(r["dst"], r["ring"]) for r in k_ring(line, 2).where("src = 'a'").collect()} == {("b", 1), ("c", 2)}
    cells = spark.createDataFrame([(c,) for c in "abcd"], "h3 string")
    w = {(r["src"], r["dst"]): r["weight"] for r in normalised_adjacency(line, cells).collect()}
    assert w["a", "a"] == pytest.approx(1 / 2) and w["a", "b"] == pytest.approx(1 / math.sqrt(6))
    rows = neighbour_weights(normalised_adjacency(line, cells)).groupBy("src").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in rows)


@pytest.mark.parametrize("case", ["mixed", "chain", "empty"])
def test_components(spark, case):
    rng = np.random.default_rng(6)
    edges = {"mixed": [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500, 500), (None, 3)], "chain": [(i, i + 1) for i in range(60)], "empty": []}[case]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {v: find(v) for v in parent}


def test_ward_keeps_groups_contiguous():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [0.05], [0.0]])
    edges = np.array([(i, i + 1) for i in range(5)])
    labels = ward_labels(x, edges, 3)
    assert labels[0] == labels[1] and labels[2] == labels[3] and labels[4] == labels[5] and len(set(labels)) == 3
    assert share_out([10, 5, 1], 8) == [4, 3, 1] and share_out([2, 1], 9) == [2, 1] and sum(share_out([40, 30, 30], 10)) == 10


def test_land_and_clipping(spark):
    df = spark.createDataFrame([(40.39, 49.85), (40.30, 50.20), (40.60, 50.10)], "lat double, lon double")
    assert [r[0] for r in df.select(on_land(F.col("lat"), F.col("lon"))).collect()] == [True, False, False]
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert sorted(clip_ring(square, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])) == [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    boxes = spark.createDataFrame([("in", 40.38, 40.40, 49.8, 49.9), ("sea", 40.0, 40.1, 50.5, 50.6)], "h3 string, lat_min double, lat_max double, lon_min double, lon_max double")
    import json

    out = {r["h3"]: json.loads(r["feature"]) for r in cells_geojson(boxes).collect()}
    ring = out["in"]["geometry"]["coordinates"][0]
    assert set(out) == {"in"} and ring[0] == ring[-1] and 49 < ring[0][0] < 51


def test_regions_and_zones(spark):
    import json

    from kvartal.operators.clustering import assign_regions, zone_features

    members = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("c", "r2")], "cell string, region string")
    centres = spark.createDataFrame([("a", 40.0, 49.0), ("b", 40.0, 49.2), ("c", 41.0, 50.0)], "cell string, lat double, lon double")
    points = spark.createDataFrame([(1, "a", 40.0, 49.0), (2, "new", 40.9, 50.0), (3, "new", 40.0, 49.1), (4, "c", 0.0, 0.0)], "id int, cell string, lat double, lon double")
    assert {r["id"]: r["region"] for r in assign_regions(points, members, centres).collect()} == {1: "r1", 2: "r2", 3: "r1", 4: "r2"}
    boxes = spark.createDataFrame([("x", 0.0, 1.0, 2.0, 3.0), ("y", 1.0, 2.0, 2.0, 3.0)], "h3 string, lat_min double, lat_max double, lon_min double, lon_max double")
    zones = spark.createDataFrame([("x", 0, "Zone 1"), ("y", 0, "Zone 1")], "h3 string, zone int, zone_name string")
    shape = json.loads(zone_features(boxes, zones).first()["feature"])
    assert len(shape["geometry"]["coordinates"]) == 2 and shape["geometry"]["coordinates"][0][0][0] == [2.0, 0.0]


def test_image_hash(spark):
    from kvartal.functions.imagehash import phash

    rng = np.random.default_rng(0)
    grey = np.clip(np.cumsum(rng.normal(0, 9, (64, 64)), axis=1) + 128, 0, 255).astype(np.uint8)
    pgm = lambda a: b"P5 64 64 255\n" + a.tobytes()
    rows = [(0, bytearray(pgm(grey))), (1, bytearray(pgm(np.clip(grey.astype(int) + 3, 0, 255).astype(np.uint8)))), (2, bytearray(b"no image")), (3, None)]
    got = [r["h"] for r in spark.createDataFrame(rows, "i int, content binary").select("i", phash(F.col("content")).alias("h")).orderBy("i").collect()]
    assert len(got[0]) == 16 and bin(int(got[0], 16) ^ int(got[1], 16)).count("1") <= 6 and got[2:] == ["", ""]


def test_boxes_in_blocks_and_nearest_centres(spark):
    from kvartal.operators.tessellation import _nearest_centres

    rng = np.random.default_rng(4)
    corners = [(f"b{i:03d}", 40 + 0.1 * (i // 10), 40.1 + 0.1 * (i // 10), 49 + 0.1 * (i % 10), 49.1 + 0.1 * (i % 10)) for i in range(90)]
    boxes = spark.createDataFrame(corners, "h3 string, lat_min double, lat_max double, lon_min double, lon_max double")
    points = [(i, float(rng.uniform(39.8, 41.2)), float(rng.uniform(48.8, 50.3))) for i in range(400)] + [(400, 0.0, 0.0), (401, 49.5, 40.2), (402, 40.1, 49.1), (402, 40.1, 49.1), (403, None, 49.0), (404, float("nan"), 49.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    whole = sorted(map(tuple, assign_boxes(df, "id", "lat", "lon", boxes).collect()))
    assert whole == sorted(map(tuple, assign_boxes(df, "id", "lat", "lon", boxes, at_once=17).collect())) and len(whole) == 404
    assert (402, "b000") in whole
    assert assign_boxes(df, "id", "lat", "lon", boxes.limit(0)).count() == 0
    lat, lon = rng.uniform(-80, 80, 3000), rng.uniform(-180, 180, 3000)
    y, x = rng.uniform(-85, 85, 200), rng.uniform(-180, 180, 200)
    from kvartal.functions.geo import haversine_m_np

    near, away = _nearest_centres(y, x, lat, lon)
    every = haversine_m_np(y[:, None], x[:, None], lat, lon) / 1000
    assert (near == every.argmin(axis=1)).all() and np.allclose(away, every.min(axis=1))
