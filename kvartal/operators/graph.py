"""Contiguity graphs of cells as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w


def box_edges(cells: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(src, dst), both ways, of boxes that touch along a side; meeting in a corner is not enough.

    ``cells``: h3, lat_min, lat_max, lon_min, lon_max.  Sides are matched by
    their rounded coordinate, so only boxes on one line are compared.
    """
    c = cells.select("h3", "lat_min", "lat_max", "lon_min", "lon_max")
    key = lambda col: F.round(F.col(col) * 1e7).cast("long")

    def along(low: str, high: str, side_a: str, side_b: str) -> DataFrame:
        a = c.select(F.col("h3").alias("src"), key(high).alias("k"), F.col(high).alias("at"), F.col(side_a).alias("a0"), F.col(side_b).alias("a1"))
        b = c.select(F.col("h3").alias("dst"), F.explode(F.array(key(low) - 1, key(low), key(low) + 1)).alias("k"), F.col(low).alias("to"), F.col(side_a).alias("b0"), F.col(side_b).alias("b1"))
        meet = (F.abs(F.col("at") - F.col("to")) <= tolerance) & (F.least("a1", "b1") - F.greatest("a0", "b0") > tolerance)
        return a.join(b, "k").where(meet & (F.col("src") != F.col("dst"))).select("src", "dst")

    one = along("lat_min", "lat_max", "lon_min", "lon_max").unionByName(along("lon_min", "lon_max", "lat_min", "lat_max"))
    return both_ways(one)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reversals, once each, without loops."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def restrict(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges with both ends among ``cells``."""
    ids = cells.select("h3").distinct()
    return edges.join(ids.select(F.col("h3").alias("src")), "src", "left_semi").join(ids.select(F.col("h3").alias("dst")), "dst", "left_semi").select("src", "dst")


def normalised_adjacency(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(src, dst, weight) of D^-1/2 (A + I) D^-1/2 over ``cells``."""
    ids = cells.select("h3").distinct()
    full = restrict(edges, cells).unionByName(ids.select(F.col("h3").alias("src"), F.col("h3").alias("dst"))).distinct()
    degree = full.groupBy("src").count()
    a, b = degree.select("src", F.col("count").alias("di")), degree.select(F.col("src").alias("dst"), F.col("count").alias("dj"))
    return full.join(a, "src").join(b, "dst").select("src", "dst", (1 / F.sqrt(F.col("di") * F.col("dj"))).alias("weight"))


def neighbour_weights(adjacency: DataFrame) -> DataFrame:
    """(src, dst, weight) with loops taken out and rows summing to one; cells without a neighbour have no row."""
    off = adjacency.where("src <> dst")
    return off.withColumn("weight", F.col("weight") / F.sum("weight").over(w.Window.partitionBy("src")))


def k_ring(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, ring) of cells within ``k`` steps, the cell itself excluded, with the least number of steps."""
    ring = edges.select("src", "dst").distinct().withColumn("ring", F.lit(1))
    reach = ring
    for step in range(2, k + 1):
        ahead = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        more = reach.where(F.col("ring") == step - 1).join(ahead, "dst").where("src <> to").select("src", F.col("to").alias("dst"), F.lit(step).alias("ring"))
        reach = reach.unionByName(more).groupBy("src", "dst").agg(F.min("ring").alias("ring"))
    return reach
