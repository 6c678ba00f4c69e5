"""Interchangeable partitions of space: hexagons, equal-count KD boxes, contiguous regions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions.geo import EARTH_RADIUS_KM, haversine_m_np
from kvartal.functions.rtree import PackedRTree
from kvartal.operators.quantiles import exact_group_median
from kvartal.sources.tables import stored

KM_PER_DEGREE = math.pi / 180 * EARTH_RADIUS_KM


@dataclass(frozen=True)
class HexGrid:
    """Hexagons of ``edge_km`` on a plane touching the earth at (lat0, lon0), by axial coordinates; ids are ``hx:q:r``.

    These are no H3 indices: the same contract (equal areas, six neighbours,
    coarser blocks) in plain column arithmetic.
    """

    edge_km: float = 0.53
    lat0: float = 40.4
    lon0: float = 49.85
    block_factor: float = 7.0

    def _axial(self, lat: Column, lon: Column, edge: float) -> tuple[Column, Column]:
        x = (lon - self.lon0) * (KM_PER_DEGREE * math.cos(math.radians(self.lat0)))
        y = (lat - self.lat0) * KM_PER_DEGREE
        q, r = (x * (math.sqrt(3) / 3) - y / 3) / edge, y * (2 / 3) / edge
        s = -q - r
        rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
        return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq), F.when((dr > ds) & ~((dq > dr) & (dq > ds)), -rq - rs).otherwise(rr)

    def cell(self, lat: Column, lon: Column) -> Column:
        """Id of the hexagon of a point; NULL where a coordinate is."""
        q, r = self._axial(lat, lon, self.edge_km)
        return F.concat(F.lit("hx:"), q.cast("string"), F.lit(":"), r.cast("string"))

    @staticmethod
    def axial(cell: Column) -> tuple[Column, Column]:
        parts = F.split(cell, ":")
        return parts[1].cast("long"), parts[2].cast("long")

    def centroid(self, cell: Column) -> tuple[Column, Column]:
        """(lat, lon) of the centre of a hexagon."""
        q, r = self.axial(cell)
        lat = self.lat0 + r * (1.5 * self.edge_km / KM_PER_DEGREE)
        lon = self.lon0 + (q + r / 2) * (math.sqrt(3) * self.edge_km / (KM_PER_DEGREE * math.cos(math.radians(self.lat0))))
        return lat, lon

    def boundary(self, cell: Column) -> Column:
        """Corners of a hexagon as an unclosed ring of (lat, lon)."""
        lat, lon = self.centroid(cell)
        scale = KM_PER_DEGREE * math.cos(math.radians(self.lat0))
        corners = [(math.sin(math.radians(60 * i - 30)) * self.edge_km / KM_PER_DEGREE, math.cos(math.radians(60 * i - 30)) * self.edge_km / scale) for i in range(6)]
        return F.array(*[F.struct((lat + dy).alias("lat"), (lon + dx).alias("lon")) for dy, dx in corners])

    def block(self, cell: Column) -> Column:
        """Id of the coarser hexagon that holds the centre."""
        lat, lon = self.centroid(cell)
        q, r = self._axial(lat, lon, self.edge_km * self.block_factor)
        return F.concat(F.lit("hb:"), q.cast("string"), F.lit(":"), r.cast("string"))

    def neighbours(self, cells: DataFrame, k: int = 1) -> DataFrame:
        """(src, dst) of hexagons within ``k`` steps, whether or not they hold points."""
        steps = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if (a, b) != (0, 0) and abs(a + b) <= k]
        q, r = self.axial(F.col("h3"))
        around = F.array(*[F.concat(F.lit("hx:"), (q + a).cast("string"), F.lit(":"), (r + b).cast("string")) for a, b in steps])
        return cells.select("h3").distinct().select(F.col("h3").alias("src"), F.explode(around).alias("dst"))


@dataclass(frozen=True)
class KDBoxes:
    """Leaves of a KD partition: a DataFrame (h3, path, lat_min, lat_max, lon_min, lon_max, n)."""

    leaves: DataFrame
    block_depth: int = 3

    def cells(self) -> DataFrame:
        """Leaves with centre and coarse block."""
        return self.leaves.select(
            "*", ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"), ((F.col("lon_min") + F.col("lon_max")) / 2).alias("lon"), kd_block(F.col("h3"), self.block_depth).alias("block")
        )


def kd_block(cell: Column, depth: int = 3) -> Column:
    """Coarse block of a KD cell: the first steps of its path."""
    path = F.substring_index(cell, ":", -1)
    return F.concat(F.lit("blk:"), F.substring(path, 1, depth))


#: Rows up to which a table of boxes is broadcast.
BROADCAST_BOXES = 100_000
#: Boxes that one pass over the points looks through.
BOXES_AT_ONCE = 200_000


def _small(t: DataFrame) -> DataFrame:
    """``t``, broadcast if its rows, counted, are few."""
    return F.broadcast(t) if t.count() <= BROADCAST_BOXES else t


def fit_kd(points: DataFrame, lat: str, lon: str, target: int = 140, min_span_m: float = 250.0, block_depth: int = 3) -> KDBoxes:
    """Equal-count boxes: median cuts across the longer side, level by level, while halving comes closer to ``target``.

    Each level counts and cuts all open boxes at once, as a table; medians are
    exact and work in bins, so the first levels, whose boxes hold all points,
    don't put them into one task.  Boxes get smaller than ``min_span_m`` at
    last, so it ends.  Points without finite coordinates play no part; without
    any the fit fails.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e9)
    rows = points.where(finite(lat) & finite(lon)).select(F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"), F.lit("").alias("path"))
    ends = rows.agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    if not ends["n"]:
        raise ValueError("no finite coordinates to fit on")
    spark = points.sparkSession
    schema = "path string, y0 double, y1 double, x0 double, x1 double, n long"
    boxes = spark.createDataFrame([("", ends["y0"] - 1e-6, ends["y1"] + 1e-6, ends["x0"] - 1e-6, ends["x1"] + 1e-6, ends["n"])], schema)
    high, wide = (F.col("y1") - F.col("y0")) * (KM_PER_DEGREE * 1000), (F.col("x1") - F.col("x0")) * (KM_PER_DEGREE * 1000) * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
    closer = (F.abs(F.col("n") / 2 - target) < F.abs(F.col("n") - target)) & (F.least(high, wide) >= min_span_m)
    leaves = None
    while True:
        done = boxes.where(~closer)
        leaves = done if leaves is None else leaves.unionByName(done)
        cuts = stored(boxes.where(closer).withColumn("by_lat", high >= wide), "kd-cuts")
        if cuts.isEmpty():
            break
        along = rows.join(_small(cuts.select("path", "by_lat")), "path").withColumn("v", F.when(F.col("by_lat"), F.col("y")).otherwise(F.col("x")))
        medians = exact_group_median(along, ["path"], "v", bins_per_e=1 << 20)
        low, top = F.when(F.col("by_lat"), F.col("y0")).otherwise(F.col("x0")), F.when(F.col("by_lat"), F.col("y1")).otherwise(F.col("x1"))
        inner = (F.col("median") > low) & (F.col("median") < top)
        at = stored(cuts.join(medians, "path").withColumn("cut", F.when(inner, F.col("median")).otherwise((low + top) / 2)).drop("median"), "kd-at")
        rows = along.join(_small(at.select("path", "cut")), "path")
        rows = stored(rows.select("y", "x", F.concat("path", F.when(F.col("v") <= F.col("cut"), "0").otherwise("1")).alias("path")), "kd-level")
        counts = rows.groupBy("path").agg(F.count("*").alias("n"))
        ends_at = lambda bit, side: F.when(F.col("by_lat") == side, F.col("cut"))
        first = F.struct(F.concat("path", F.lit("0")).alias("path"), "y0", F.coalesce(ends_at(0, True), "y1").alias("y1"), "x0", F.coalesce(ends_at(0, False), "x1").alias("x1"))
        second = F.struct(F.concat("path", F.lit("1")).alias("path"), F.coalesce(ends_at(1, True), "y0").alias("y0"), "y1", F.coalesce(ends_at(1, False), "x0").alias("x0"), "x1")
        halves = at.select(F.explode(F.array(first, second)).alias("h")).select("h.*")
        boxes = stored(halves.join(counts, "path", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), "kd-boxes")
    name = F.concat(F.lit("kd:"), F.when(F.col("path") == "", "r").otherwise(F.col("path")))
    table = leaves.select(name.alias("h3"), "path", F.col("y0").alias("lat_min"), F.col("y1").alias("lat_max"), F.col("x0").alias("lon_min"), F.col("x1").alias("lon_max"), "n")
    return KDBoxes(stored(table, "kd-leaves"), block_depth)


def _nearest_centres(y: np.ndarray, x: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre by great circle, the first of equals, and its distance in km.

    Centres are sorted by latitude; a point looks at those around its own in
    growing bands until the difference of latitude alone is farther.
    """
    order = np.argsort(lat, kind="stable")
    sorted_lat, n = lat[order], len(lat)
    best, far = np.zeros(len(y), dtype=np.int64), np.full(len(y), np.inf)
    at, left, width = np.searchsorted(sorted_lat, y), np.arange(len(y)), min(n, 64)
    while len(left):
        for some in np.array_split(left, max(1, len(left) * min(n, 2 * width) // 4_000_000)):
            low, high = np.maximum(0, at[some] - width), np.minimum(n, at[some] + width)
            columns = low[:, None] + np.arange(min(n, 2 * width))[None, :]
            valid = columns < high[:, None]
            ids = order[np.minimum(columns, n - 1)]
            d = np.where(valid, haversine_m_np(y[some][:, None], x[some][:, None], lat[ids], lon[ids]) / 1000, np.inf)
            near = d.min(axis=1)
            first = np.where(d <= near[:, None], ids, n).min(axis=1)
            best[some], far[some] = first, near
        low, high = np.maximum(0, at[left] - width), np.minimum(n, at[left] + width)
        below = np.where(low > 0, np.abs(y[left] - sorted_lat[np.maximum(low - 1, 0)]), np.inf)
        above = np.where(high < n, np.abs(sorted_lat[np.minimum(high, n - 1)] - y[left]), np.inf)
        left = left[np.minimum(below, above) * KM_PER_DEGREE <= far[left] * (1 + 1e-9)]
        width *= 4
    return best, far


def assign_boxes(points: DataFrame, point_id: str, lat: str, lon: str, boxes: DataFrame, at_once: int = BOXES_AT_ONCE) -> DataFrame:
    """(``point_id``, cell): the first box, by id, that holds the point (borders included), else the box with the nearest centre.

    Boxes are packed into an R-tree that each task probes with its points, so
    points aren't shuffled.  More boxes than ``at_once`` are taken in blocks, and
    the best of all blocks is kept for each row.  Points
    lacking a coordinate have no row; repeated ids are rows of their own.
    """
    id_type = points.schema[point_id].dataType.simpleString()
    good = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    p = points.where(good).select(F.col(point_id).alias("pid"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    table = boxes.select("h3", "lat_min", "lat_max", "lon_min", "lon_max")
    number = table.count()
    if not number:
        return p.select(F.col("pid").alias(point_id), F.lit(None).cast("string").alias("cell")).limit(0)
    blocks = -(-number // at_once)
    if blocks > 1:
        table = stored(table.withColumn("block", F.pmod(F.xxhash64("h3"), F.lit(blocks)) + 1), "boxes")
        p = stored(p.withColumn("row", F.monotonically_increasing_id()), "points")
    found = None
    for block in range(1, blocks + 1):
        # At most ``at_once`` boxes, or so, come to the driver and go to the tasks.
        b = (table.where(F.col("block") == block) if blocks > 1 else table).orderBy("h3").toPandas()
        ids, sides = b["h3"].to_numpy(), [b[c].to_numpy(dtype=float) for c in ("lat_min", "lat_max", "lon_min", "lon_max")]

        def assign(batches, ids=ids, sides=sides):
            tree = PackedRTree(*sides)
            lat_mid, lon_mid = (sides[0] + sides[1]) / 2, (sides[2] + sides[3]) / 2
            for pdf in batches:
                y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
                q, box = tree.probe(y, y, x, x)
                first = np.full(len(pdf), len(ids), dtype=np.int64)
                np.minimum.at(first, q, box)
                away = np.where(first < len(ids), -1.0, np.inf)
                out = np.flatnonzero(first == len(ids))
                if len(out):
                    first[out], away[out] = _nearest_centres(y[out], x[out], lat_mid, lon_mid)
                yield pdf.drop(columns=["y", "x"]).assign(cell=ids[first], away=away)

        part = p.mapInPandas(assign, f"pid {id_type}, {'row long, ' if blocks > 1 else ''}cell string, away double")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("row").agg(F.first("pid").alias("pid"), F.min_by("cell", F.struct("away", "cell")).alias("cell"))
    return found.select(F.col("pid").alias(point_id), "cell")


def describe_cells(cells: DataFrame, size: str = "n", block: Column | None = None) -> DataFrame:
    """Number of cells, least, median and greatest size, number of blocks."""
    return cells.agg(
        F.count("*").alias("cells"), F.min(size).alias("least"), F.median(size).alias("median"), F.max(size).alias("greatest"), F.countDistinct(kd_block(F.col("h3")) if block is None else block).alias("blocks")
    )
