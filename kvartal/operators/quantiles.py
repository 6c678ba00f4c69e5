"""Exact medians of large skewed groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

BINS_PER_E = 64


def _bin(value: Column, bins_per_e: int) -> Column:
    """Number of an order-preserving logarithmic bin; at 64 per factor e, some 90,000 cover all doubles."""
    return F.signum(value) * F.floor(F.log1p(F.abs(value)) * bins_per_e)


def exact_group_median(df: DataFrame, keys: list[str], value: str, bins_per_e: int = BINS_PER_E) -> DataFrame:
    """Exact interpolated median of ``value`` for each combination of ``keys``.

    Counts per bin tell which bins hold the two middle ranks; only rows of those
    bins are ranked.  So the largest unit of work is one bin of one group, in
    distinct values, and not a group.  NULL and NaN values are passed over, and
    a group of nothing else has no row.  NULL keys form groups of their own.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", _bin(F.col("_v"), bins_per_e))
    by_key = w.Window.partitionBy(*keys)
    upto = F.sum("_n").over(by_key.orderBy("_b"))
    total = F.sum("_n").over(by_key)
    low, high = F.floor((F.col("_t") + 1) / 2), F.floor(F.col("_t") / 2) + 1
    bins = (
        rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumn("_u", upto).withColumn("_t", total)
        .where((low.between(F.col("_u") - F.col("_n") + 1, F.col("_u"))) | (high.between(F.col("_u") - F.col("_n") + 1, F.col("_u"))))
        .select(*[F.col(k).alias("_k" + k) for k in keys], F.col("_b").alias("_bb"), (F.col("_u") - F.col("_n")).alias("_before"), low.alias("_low"), high.alias("_high"))
    )
    same = F.col("_b") == F.col("_bb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k" + k))
    inside = rows.join(bins, same).groupBy(*keys, "_b", "_v", "_before", "_low", "_high").agg(F.count("*").alias("_n"))
    upto = F.col("_before") + F.sum("_n").over(w.Window.partitionBy(*keys, "_b").orderBy("_v"))
    ranked = inside.withColumn("_u", upto)
    holds = lambda rank: F.col(rank).between(F.col("_u") - F.col("_n") + 1, F.col("_u"))
    return ranked.groupBy(*keys).agg(((F.max(F.when(holds("_low"), F.col("_v"))) + F.max(F.when(holds("_high"), F.col("_v")))) / 2).alias("median"))
