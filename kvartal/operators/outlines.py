"""Outlines of cells: dissolved polygons, stored ones read back, the polygon nearest to a point."""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.constants import LAND
from kvartal.operators.features import clip_ring

DIGITS = 9
#: Polygons up to which their table goes to the tasks that look for the nearest.
POLYGONS_AT_ONCE = 20_000


def dissolve(rings: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed outlines of the union of polygons that touch but don't overlap.

    Sides are cut at the corners that lie on them; what two polygons share
    runs both ways and cancels.  Outer rings run counter-clockwise, holes
    clockwise; corners on a straight line are dropped.
    """
    near = lambda p: (round(p[0], DIGITS), round(p[1], DIGITS))
    polygons = []
    for ring in rings:
        points = [near(p) for p in ring]
        points = [p for i, p in enumerate(points) if p != points[i - 1]]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))
        if len(points) >= 3 and area:
            polygons.append(points if area > 0 else points[::-1])
    by_x, by_y = defaultdict(set), defaultdict(set)
    for points in polygons:
        for x, y in points:
            by_x[x].add(y)
            by_y[y].add(x)
    sides: dict[tuple, int] = defaultdict(int)
    for points in polygons:
        for a, b in zip(points, points[1:] + points[:1]):
            if a[0] == b[0]:
                on = [(a[0], y) for y in by_x[a[0]] if min(a[1], b[1]) < y < max(a[1], b[1])]
            elif a[1] == b[1]:
                on = [(x, a[1]) for x in by_y[a[1]] if min(a[0], b[0]) < x < max(a[0], b[0])]
            else:
                on = []
            line = [a, *sorted(on, key=lambda p: abs(p[0] - a[0]) + abs(p[1] - a[1])), b]
            for p, q in zip(line, line[1:]):
                if sides.get((q, p)):
                    sides[(q, p)] -= 1
                else:
                    sides[(p, q)] += 1
    after = defaultdict(list)
    for (p, q), n in sides.items():
        after[p] += [q] * n
    out = []
    for start in sorted(after):
        while after[start]:
            ring, here = [start], after[start].pop()
            while here != start:
                ring.append(here)
                ways = after[here]
                # Where outlines meet in a corner, turn left as far as can be, so that they stay apart.
                back = (ring[-2][0] - here[0], ring[-2][1] - here[1])
                turn = lambda q: np.arctan2(back[0] * (q[1] - here[1]) - back[1] * (q[0] - here[0]), back[0] * (q[0] - here[0]) + back[1] * (q[1] - here[1])) % (2 * np.pi)  # noqa: B023, E731
                best = max(range(len(ways)), key=lambda i: turn(ways[i]))
                here = ways.pop(best)
            kept = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % len(ring)][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % len(ring)][0] - p[0])]
            if len(kept) >= 3:
                out.append([*kept, kept[0]])
    return out


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def dissolved(polygons: DataFrame, key: str, properties: list[str] | None = None) -> DataFrame:
    """(key, feature): the union of each group's polygons as GeoJSON; ``polygons`` has key, h3 and feature (a polygon each).

    A group's polygons go to one task: they are cells, of which a zone or
    region has tens or hundreds.
    """
    names = [c for c in (properties or []) if c != key]
    key_type = polygons.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h3")
        rings = dissolve([[tuple(p) for p in json.loads(f)["geometry"]["coordinates"][0][:-1]] for f in pdf["feature"]])
        outer, holes = [r for r in rings if _area(r) > 0], [r for r in rings if _area(r) < 0]
        inside = lambda p, ring: sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1
        parts = [[r, *[h for h in holes if inside(((h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2), r)]] for r in outer]
        shape = {"type": "Polygon", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPolygon", "coordinates": parts}
        plain = lambda v: v.item() if hasattr(v, "item") else v
        about = {key: plain(pdf[key].iloc[0]), **{c: plain(pdf[c].iloc[0]) for c in names}, "n_cells": len(pdf)}
        return pd.DataFrame({key: [pdf[key].iloc[0]], "feature": [json.dumps({"type": "Feature", "geometry": shape, "properties": about}, ensure_ascii=False)]})

    return polygons.select(key, "h3", "feature", *names).groupBy(key).applyInPandas(one, f"`{key}` {key_type}, feature string")


def stored_polygons(collection: DataFrame) -> DataFrame:
    """(h3, feature) of a stored collection, one GeoJSON feature a row as ``feature``: polygons of at least three corners with an id."""
    shape = "id string, properties struct<h3: string>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    f = F.from_json("feature", shape)
    rows = collection.select("feature", f.alias("f")).select("feature", F.coalesce("f.id", "f.properties.h3").alias("h3"), "f.geometry")
    return rows.where((F.col("geometry.type") == "Polygon") & F.col("h3").isNotNull() & (F.size(F.col("geometry.coordinates")[0]) >= 4)).select("h3", "feature")


def subset_polygons(collection: DataFrame, cells: DataFrame, clip: bool = True) -> DataFrame:
    """(h3, feature) of the stored polygons of ``cells``, convex ones cut to the land, with the other columns of ``cells`` as properties."""
    rest = [c for c in cells.columns if c != "h3"]
    rows = stored_polygons(collection).join(cells.select("h3", F.to_json(F.struct(*rest)).alias("props") if rest else F.lit("{}").alias("props")), "h3")

    def cut(batches):
        for pdf in batches:
            ids, out = [], []
            for h3, feature, props in zip(pdf["h3"], pdf["feature"], pdf["props"]):
                ring = [tuple(p) for p in json.loads(feature)["geometry"]["coordinates"][0][:-1]]
                ring = clip_ring(LAND, ring) if clip else ring
                if len(ring) < 3:
                    continue
                ids.append(h3)
                shape = {"type": "Polygon", "coordinates": [[list(p) for p in [*ring, ring[0]]]]}
                out.append(json.dumps({"type": "Feature", "id": h3, "geometry": shape, "properties": {"h3": h3, **json.loads(props)}}, ensure_ascii=False))
            yield pd.DataFrame({"h3": ids, "feature": out}, dtype=object)

    return rows.mapInPandas(cut, "h3 string, feature string")


def _distance_to(y: np.ndarray, x: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Distance in degrees of points to a polygon [n, (lon, lat)], 0 inside."""
    a, b = ring, np.roll(ring, -1, axis=0)
    px, py = x[:, None], y[:, None]
    dx, dy = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]
    length = np.where(dx * dx + dy * dy > 0, dx * dx + dy * dy, 1.0)
    t = np.clip(((px - a[:, 0]) * dx + (py - a[:, 1]) * dy) / length, 0, 1)
    away = np.hypot(px - a[:, 0] - t * dx, py - a[:, 1] - t * dy).min(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((a[:, 1] > py) != (b[:, 1] > py)) & (px < dx * (py - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])
    return np.where(cross.sum(axis=1) % 2 == 1, 0.0, away)


def nearest_polygon(points: DataFrame, point_id: str, lat: str, lon: str, polygons: DataFrame) -> DataFrame:
    """(``point_id``, h3): the polygon that holds or is nearest to each point, in degrees; of equals the first by id.

    ``polygons``: (h3, feature) of cells, at most POLYGONS_AT_ONCE at a time;
    more are taken in blocks, and the nearest of all is kept.  Points lacking a
    coordinate have no row; without polygons there are none.
    """
    id_type = points.schema[point_id].dataType.simpleString()
    p = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)).select(F.col(point_id).alias("pid"), F.col(lat).alias("y"), F.col(lon).alias("x"))
    blocks = max(1, -(-polygons.count() // POLYGONS_AT_ONCE))
    found = None
    for block in range(blocks):
        some = polygons.select("h3", "feature").where(F.pmod(F.xxhash64("h3"), F.lit(blocks)) == block).orderBy("h3").collect()  # a block
        ids, rings = [r["h3"] for r in some], [np.array(json.loads(r["feature"])["geometry"]["coordinates"][0][:-1], dtype=float) for r in some]
        if not ids:
            continue
        low, high = np.stack([r.min(axis=0) for r in rings]), np.stack([r.max(axis=0) for r in rings])

        def search(batches, ids=ids, rings=rings, low=low, high=high):
            names = np.array(ids, dtype=object)
            for whole in batches:
                for start in range(0, len(whole), 2_000):
                    pdf = whole.iloc[start : start + 2_000]
                    y, x = pdf["y"].to_numpy(dtype=float), pdf["x"].to_numpy(dtype=float)
                    gap = np.hypot(np.maximum(0, np.maximum(low[:, 0] - x[:, None], x[:, None] - high[:, 0])), np.maximum(0, np.maximum(low[:, 1] - y[:, None], y[:, None] - high[:, 1])))
                    best, away = np.full(len(pdf), len(ids)), np.full(len(pdf), np.inf)
                    # The polygon of the nearest box first; then those whose box is nearer than what that gave.
                    first = gap.argmin(axis=1)
                    for rounds in (0, 1):
                        pairs = np.stack([np.arange(len(pdf)), first], axis=1) if rounds == 0 else np.argwhere(gap <= away[:, None])
                        pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
                        cuts = np.flatnonzero(np.r_[True, pairs[1:, 1] != pairs[:-1, 1]]) if len(pairs) else []
                        for a, b in zip(cuts, [*cuts[1:], len(pairs)]):
                            k, rows = pairs[a, 1], pairs[a:b, 0]
                            d = _distance_to(y[rows], x[rows], rings[k])
                            better = (d < away[rows]) | ((d == away[rows]) & (k < best[rows]))
                            best[rows[better]], away[rows[better]] = k, d[better]
                    yield pd.DataFrame({"pid": pdf["pid"], "h3": names[best], "away": away})

        part = p.mapInPandas(search, f"pid {id_type}, h3 string, away double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return p.select(F.col("pid").alias(point_id), F.lit(None).cast("string").alias("h3")).limit(0)
    if blocks > 1:
        found = found.groupBy("pid").agg(F.min_by("h3", F.struct("away", "h3")).alias("h3"))
    return found.select(F.col("pid").alias(point_id), "h3")
