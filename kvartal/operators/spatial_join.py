"""Points within reach of circles or inside polygons, by a sampled quadtree.

A bounded sample of the points fixes the leaves of a quadtree.  Every point
belongs to one leaf; every shape is copied to all leaves its box touches.  Each
leaf packs its shapes into an R-tree, probes its points and tests the
candidates exactly.  A pair is reported by the leaf that owns its reference
point, which is the point itself, so no pair comes out twice.  Leaves that the
sample shows to be too full (many rows at one place can't be split in space)
are divided into a grid of point shares times shape shares, so that no task
gets more than a bounded part of either side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.functions.geo import circle_boxes, haversine_m_np, inside_rings, wrap_boxes
from kvartal.functions.rtree import PackedRTree

DEPTH = 24
SHAPE_SCHEMA = "target_id string, lat double, lon double, radius_m double, rings array<struct<ring_no: int, lat: array<double>, lon: array<double>>>"


def _spread(v: np.ndarray) -> np.ndarray:
    """The low 24 bits of ``v`` with a zero bit after each."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def morton(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Quadtree code of degree points at full depth (rows of the world box only)."""
    side = 1 << DEPTH
    y = np.clip(np.floor((lat + 90) / 180 * side), 0, side - 1).astype(np.int64)
    x = np.clip(np.floor((lon + 180) / 360 * side), 0, side - 1).astype(np.int64)
    return ((_spread(y) << np.uint64(1)) | _spread(x)).astype(np.int64)


@dataclass
class Quadtree:
    """Leaves as starts of code intervals, their boxes, and into how many shares each side of a leaf is cut."""

    starts: np.ndarray
    boxes: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    point_shares: np.ndarray
    shape_shares: np.ndarray

    @classmethod
    def fit(cls, lat: np.ndarray, lon: np.ndarray, total: int, leaf_rows: int) -> "Quadtree":
        """Split while a leaf's share of ``total``, as the sample shows it, exceeds ``leaf_rows``."""
        codes = np.sort(morton(lat, lon))
        scale = max(1, total) / max(1, len(codes))
        limit = max(16.0, leaf_rows / scale)
        leaves, stack = [], [(0, 0, 0, 0, 0, len(codes))]
        while stack:
            start, depth, y, x, a, b = stack.pop()
            if b - a <= limit or depth == DEPTH:
                leaves.append((start, depth, y, x, b - a))
                continue
            width = 1 << (2 * (DEPTH - depth - 1))
            cuts = np.searchsorted(codes[a:b], [start + width * k for k in range(5)]) + a
            for k in range(4):
                stack.append((start + width * k, depth + 1, 2 * y + (k >> 1), 2 * x + (k & 1), cuts[k], cuts[k + 1]))
        leaves.sort()
        start, depth, y, x, n = (np.array(v, dtype=np.int64) for v in zip(*leaves))
        h, w = 180.0 / (1 << depth), 360.0 / (1 << depth)
        boxes = (y * h - 90, (y + 1) * h - 90, x * w - 180, (x + 1) * w - 180)
        shares = np.maximum(1, np.ceil(n * scale / leaf_rows)).astype(np.int64)
        return cls(start, boxes, shares, np.ones(len(start), dtype=np.int64))

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, morton(lat, lon), side="right") - 1


def circle_shapes(df: DataFrame, target_id: str, lat: str, lon: str, radius_m) -> DataFrame:
    """Circles as shapes; rows lacking a coordinate or a radius, or with a negative one, reach nothing."""
    radius = F.col(radius_m) if isinstance(radius_m, str) else F.lit(float(radius_m))
    out = df.select(
        F.col(target_id).cast("string").alias("target_id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), radius.cast("double").alias("radius_m")
    )
    good = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("lat", "lon", "radius_m")]
    return out.where(good[0] & good[1] & good[2] & (F.col("radius_m") >= 0) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).withColumn(
        "rings", F.lit(None).cast("array<struct<ring_no: int, lat: array<double>, lon: array<double>>>")
    )


def polygon_shapes(df: DataFrame, target_id: str, ring: str, vertex: str, lat: str, lon: str) -> DataFrame:
    """Polygons as shapes from one row per vertex; one polygon is one object and is gathered whole."""
    v = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(target_id).cast("string").alias("target_id"), F.coalesce(F.col(ring).cast("int"), F.lit(0)).alias("ring_no"), F.col(vertex).alias("n"), F.col(lat).alias("y"), F.col(lon).alias("x")
    )
    rings = v.dropDuplicates(["target_id", "ring_no", "n"]).groupBy("target_id", "ring_no").agg(F.sort_array(F.collect_list(F.struct("n", "y", "x"))).alias("v"))
    return rings.groupBy("target_id").agg(F.collect_list(F.struct("ring_no", F.col("v.y").alias("lat"), F.col("v.x").alias("lon"))).alias("rings")).select(
        "target_id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("radius_m"), "rings"
    )


def _boxes_of(pdf: pd.DataFrame):
    lat, lon, radius = (pdf[c].to_numpy(dtype=float) for c in ("lat", "lon", "radius_m"))
    boxes = [np.array(b, dtype=float) for b in circle_boxes(lat, lon, np.nan_to_num(radius))]
    for i, rings in enumerate(pdf["rings"]):
        if rings is not None:
            ys, xs = np.concatenate([r["lat"] for r in rings]), np.concatenate([r["lon"] for r in rings])
            for b, v in zip(boxes, (ys.min(), ys.max(), xs.min(), xs.max())):
                b[i] = v
    return boxes


def _share(ids: pd.Series, shares: np.ndarray) -> np.ndarray:
    if (shares <= 1).all():
        return np.zeros(len(ids), dtype=np.int64)
    return (pd.util.hash_array(ids.to_numpy()).astype(np.uint64) % shares.astype(np.uint64)).astype(np.int64)


def _block(tree: Quadtree, leaf, p, s):
    """Number of a share of points times a share of shapes of a leaf; the leaves' blocks follow one another."""
    blocks = tree.point_shares * tree.shape_shares
    return (np.cumsum(blocks) - blocks)[leaf] + p * tree.shape_shares[leaf] + s


def within_reach(points: DataFrame, point_id: str, lat: str, lon: str, shapes: DataFrame, sample_rows: int = 50_000, leaf_rows: int = 40_000, leaf_shapes: int = 40_000, unique_ids: bool = False) -> DataFrame:
    """All pairs of a point and a shape that reaches or contains it: (``point_id``, target_id).

    ``shapes`` comes from :func:`circle_shapes` and :func:`polygon_shapes`.
    Distances are great circles; polygon edges are straight in (lon, lat).

    Points lacking a coordinate, with NaN, or off the globe have no pairs, as
    have shapes lacking one.  Points count once for each ``point_id`` and
    target, also where a target is listed twice, or a point with several places
    (``unique_ids`` says that there are none, and saves looking for them).
    Points exactly at the radius are within it.  An empty side gives an empty result.  Other columns of
    either side play no part, so their names can't clash.
    """
    spark = points.sparkSession
    id_type = points.schema[point_id].dataType.simpleString()
    p = points.select(F.col(point_id).alias("pid"), F.col(lat).cast("double").alias("plat"), F.col(lon).cast("double").alias("plon"))
    p = p.where(F.col("pid").isNotNull() & F.col("plat").between(-90, 90) & F.col("plon").between(-180, 180))
    total = p.count()
    part = p.select("plat", "plon")
    if total > sample_rows:
        part = part.sample(sample_rows / total, seed=7)
    rough = part.limit(2 * sample_rows).toPandas()
    tree = Quadtree.fit(rough["plat"].to_numpy(), rough["plon"].to_numpy(), total, leaf_rows)

    def to_leaves(batches):
        leaves = PackedRTree(*tree.boxes)
        for pdf in batches:
            box = wrap_boxes(*_boxes_of(pdf))
            q, leaf = leaves.probe(*box[1:])
            pair = np.unique(np.stack([box[0][q], leaf], axis=1), axis=0) if len(q) else np.empty((0, 2), np.int64)
            yield pdf.iloc[pair[:, 0]].assign(leaf=pair[:, 1])

    placed = shapes.mapInPandas(to_leaves, SHAPE_SCHEMA + ", leaf long")
    # One row per leaf, and the leaves are bounded by the sample.
    for r in placed.groupBy("leaf").count().where(F.col("count") > leaf_shapes).collect():
        tree.shape_shares[r["leaf"]] = -(-r["count"] // leaf_shapes)

    def point_blocks(batches):
        for pdf in batches:
            leaf = tree.leaf(pdf["plat"].to_numpy(), pdf["plon"].to_numpy())
            p_share = _share(pdf["pid"], tree.point_shares[leaf])
            copies = tree.shape_shares[leaf]
            at = np.repeat(np.arange(len(pdf)), copies)
            s = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pdf.iloc[at].assign(block=_block(tree, leaf[at], p_share[at], s))

    def shape_blocks(batches):
        for pdf in batches:
            leaf = pdf["leaf"].to_numpy()
            s_share = _share(pdf["target_id"], tree.shape_shares[leaf])
            copies = tree.point_shares[leaf]
            at = np.repeat(np.arange(len(pdf)), copies)
            k = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pdf.iloc[at].drop(columns="leaf").assign(block=_block(tree, leaf[at], k, s_share[at]))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"pid": left["pid"].iloc[:0], "target_id": pd.Series([], dtype=str)})
        y, x = left["plat"].to_numpy(), left["plon"].to_numpy()
        box = wrap_boxes(*_boxes_of(right))
        q, b = PackedRTree(*box[1:]).probe(y, y, x, x)
        shape = box[0][b]
        circle = right["rings"].isna().to_numpy()
        slat, slon, radius = (right[c].to_numpy(dtype=float) for c in ("lat", "lon", "radius_m"))
        keep = circle[shape].copy()
        c = np.flatnonzero(keep)
        keep[c] = haversine_m_np(y[q[c]], x[q[c]], slat[shape[c]], slon[shape[c]]) <= radius[shape[c]]
        by_shape = np.argsort(shape, kind="stable")
        ordered = shape[by_shape]
        for i in np.flatnonzero(~circle):
            mine = by_shape[slice(*np.searchsorted(ordered, [i, i + 1]))]
            rings = [(np.asarray(r["lat"], dtype=float), np.asarray(r["lon"], dtype=float)) for r in right["rings"].iloc[i]]
            for a in range(0, len(mine), 20_000):
                m = mine[a : a + 20_000]
                keep[m] = inside_rings(y[q[m]], x[q[m]], rings)
        out = pd.DataFrame({"pid": left["pid"].to_numpy()[q[keep]], "target_id": right["target_id"].to_numpy()[shape[keep]]})
        return out.drop_duplicates()

    left = p.mapInPandas(point_blocks, f"pid {id_type}, plat double, plon double, block long")
    right = placed.mapInPandas(shape_blocks, SHAPE_SCHEMA + ", block long")
    out = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(probe, f"pid {id_type}, target_id string")
    return (out if unique_ids else out.distinct()).withColumnRenamed("pid", point_id)
