"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.sources.tables import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u, v): neighbours that are larger (or, if ``small``, not larger) move to the least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = both.where("v <= u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    moved = both.join(least, both["u"] == least["w"])
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; the component is its least node.

    Alternating large and small stars: edges shrink to stars around least
    nodes in few rounds, also on long chains.  Each round is written to the
    shared folder.  Loops, repeated edges and edges with a NULL end are
    allowed; a node with only loops is its own component.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    alone = pairs.where("u = v").select("u").distinct()
    now = stored(pairs.where("u <> v").distinct(), "components")
    before = None
    for _ in range(most_rounds):
        now = stored(_star(_star(now, small=False), small=True), "components")
        # Full-width hashes of all edges: different rounds don't agree in all of them.
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(11), "u")), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    lone = alone.join(found, alone["u"] == found["node"], "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return found.unionByName(lone)
