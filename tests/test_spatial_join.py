import numpy as np
import pytest

from kvartal.functions.geo import haversine_m_np, inside_rings
from kvartal.functions.rtree import PackedRTree
from kvartal.operators.spatial_join import circle_shapes, polygon_shapes, within_reach

P = "row_no long, lat double, lon double, target_id string"


def brute(points, circles, polygons):
    out = set()
    for i, y, x, *_ in points:
        if y is None or x is None or y != y or x != x or abs(y) > 90 or abs(x) > 180:
            continue
        for t, cy, cx, r in circles:
            if None not in (cy, cx, r) and r >= 0 and haversine_m_np(np.array([y]), np.array([x]), cy, cx)[0] <= r:
                out.add((i, t))
        for t, ring in polygons.items():
            rings = [(np.array([v[0] for v in vs]), np.array([v[1] for v in vs])) for vs in ring]
            if inside_rings(np.array([y]), np.array([x]), rings)[0]:
                out.add((i, t))
    return out


def polygon_rows(polygons):
    return [(t, k, n, y, x) for t, rings in polygons.items() for k, vs in enumerate(rings) for n, (y, x) in enumerate(vs)]


@pytest.mark.parametrize("leaf_rows,leaf_shapes", [(40_000, 40_000), (40, 7)])
def test_matches_brute_force(spark, leaf_rows, leaf_shapes):
    rng = np.random.default_rng(3)
    points = [(i, float(y), float(x), "clash") for i, (y, x) in enumerate(rng.uniform([40, 49], [41, 50], (400, 2)))]
    points += [(1000 + i, 40.5, 49.5, None) for i in range(200)]  # a third at one place
    points += [(5000, None, 49.0, None), (5001, 40.0, None, None), (5002, float("nan"), 49.0, None), (5003, 49.5, 40.5, None), (5004, 0.0, 0.0, None), (5005, 95.0, 49.5, None), (5006, 0.0, 179.999, None)]
    circles = [(f"c{i}", float(y), float(x), float(r)) for i, (y, x, r) in enumerate(rng.uniform([40, 49, 500], [41, 50, 9000], (60, 3)))]
    circles += [("c1", circles[1][1], circles[1][2], circles[1][3]), ("none", None, 49.5, 100.0), ("bad", 40.5, 49.5, -1.0), ("nor", 40.5, 49.5, None), ("line", 0.0, -179.999, 5000.0), ("pole", 89.9, 10.0, 30000.0)]
    polygons = {"square": [[(40.2, 49.2), (40.2, 49.8), (40.8, 49.8), (40.8, 49.2)], [(40.4, 49.4), (40.4, 49.6), (40.6, 49.6), (40.6, 49.4)]], "tri": [[(40.0, 49.0), (40.9, 49.1), (40.1, 49.9)]]}
    shapes = circle_shapes(spark.createDataFrame(circles, "place_id string, lat double, lon double, radius_m double"), "place_id", "lat", "lon", "radius_m").unionByName(
        polygon_shapes(spark.createDataFrame(polygon_rows(polygons), "r string, ring_no int, vertex_no int, lat double, lon double"), "r", "ring_no", "vertex_no", "lat", "lon")
    )
    got = within_reach(spark.createDataFrame(points, P), "row_no", "lat", "lon", shapes, sample_rows=300, leaf_rows=leaf_rows, leaf_shapes=leaf_shapes).collect()
    pairs = [(r["row_no"], r["target_id"]) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(points, circles, polygons)
    assert (5006, "line") in pairs


def test_empty_sides(spark):
    none = spark.createDataFrame([], "row_no long, lat double, lon double")
    some = spark.createDataFrame([(1, 40.0, 49.0)], "row_no long, lat double, lon double")
    shapes = circle_shapes(some, "row_no", "lat", "lon", 100.0)
    assert within_reach(none, "row_no", "lat", "lon", shapes).count() == 0
    assert within_reach(some, "row_no", "lat", "lon", circle_shapes(none, "row_no", "lat", "lon", 100.0)).count() == 0
    assert within_reach(some, "row_no", "lat", "lon", shapes).count() == 1


def test_rtree_finds_all_boxes():
    rng = np.random.default_rng(1)
    lo = rng.uniform(0, 10, (500, 2))
    hi = lo + rng.uniform(0, 0.5, (500, 2))
    q = rng.uniform(0, 10, (50, 2))
    a, b = PackedRTree(lo[:, 0], hi[:, 0], lo[:, 1], hi[:, 1]).probe(q[:, 0], q[:, 0], q[:, 1], q[:, 1])
    want = {(i, j) for i in range(50) for j in range(500) if (lo[j] <= q[i]).all() and (q[i] <= hi[j]).all()}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_a_point_with_two_places_comes_once(spark):
    points = spark.createDataFrame([(1, 40.0, 49.0), (1, 40.01, 49.01), *[(i, 40.0 + i * 1e-4, 49.0) for i in range(2, 400)]], "id long, lat double, lon double")
    shapes = circle_shapes(spark.createDataFrame([("t", 40.0, 49.0)], "k string, lat double, lon double"), "k", "lat", "lon", 50_000.0)
    got = [tuple(r) for r in within_reach(points, "id", "lat", "lon", shapes, sample_rows=300, leaf_rows=20).collect()]
    assert len(got) == len(set(got)) == 399


def test_many_shares_keep_blocks_apart(spark):
    points = spark.createDataFrame([(i, 40.0, 49.0) for i in range(3000)], "id long, lat double, lon double")
    shapes = circle_shapes(spark.createDataFrame([(f"t{i}", 40.0, 49.0) for i in range(30)], "k string, lat double, lon double"), "k", "lat", "lon", 10.0)
    assert within_reach(points, "id", "lat", "lon", shapes, leaf_rows=100, leaf_shapes=7, unique_ids=True).count() == 90_000
