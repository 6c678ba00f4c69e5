"""Calibrated intervals: conformal offsets, bounds, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from kvartal.functions.numeric import finite


def check_windows(train: list[str], calibration: list[str]) -> None:
    """Calibration months must come after all training months."""
    if not train or not calibration:
        raise ValueError("both windows need months")
    if max(train) >= min(calibration):
        raise ValueError("calibration must come after training")


def conformal_offset(df: DataFrame, actual: str, low: str, high: str, alpha: float = 0.2) -> DataFrame:
    """One row (offset, n): the ceil((n + 1)(1 - alpha))-th smallest score, at most the largest.

    A score is how far the value lies outside its interval.  The rank is found
    by counting scores, not by sorting all rows in one task.
    """
    scores = df.select(F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high)).alias("s")).where(finite(F.col("s")))
    counts = scores.groupBy("s").agg(F.count("*").alias("c"), F.floor(F.col("s") * 16).alias("bin"))
    bins = counts.groupBy("bin").agg(F.sum("c").alias("c"))
    n = bins.agg(F.sum("c").alias("n"))
    by_bin = w.Window.orderBy("bin")
    rank = F.least(F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9)), F.col("n"))
    upto = bins.withColumn("upto", F.sum("c").over(by_bin)).crossJoin(F.broadcast(n)).withColumn("rank", rank)  # one row
    chosen = upto.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))).select("bin", "rank", (F.col("upto") - F.col("c")).alias("before"), "n")
    inside = counts.join(F.broadcast(chosen), "bin").withColumn("u", F.col("before") + F.sum("c").over(w.Window.partitionBy("bin").orderBy("s")))
    return inside.where((F.col("rank") <= F.col("u")) & (F.col("rank") > F.col("u") - F.col("c"))).select(F.col("s").alias("offset"), F.col("n").cast("long").alias("n"))


def widen(low: Column, middle: Column, high: Column, offset: Column) -> list[Column]:
    """q10, q50, q90 with the offset, kept in order."""
    return [F.least(low - offset, middle).alias("q10"), middle.alias("q50"), F.greatest(high + offset, middle).alias("q90")]


def coverage(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    """Share of finite rows inside their interval, borders included."""
    ok = finite(F.col(actual)) & finite(F.col(low)) & finite(F.col(high))
    return df.where(ok).agg(F.avg(F.when(F.col(actual).between(F.col(low), F.col(high)), 1.0).otherwise(0.0)).alias("coverage"), F.count("*").alias("n"))


def residual_band(df: DataFrame, actual: str, predicted: str, share: float = 0.8) -> DataFrame:
    """One row with the interpolated percentile of absolute residuals: an in-sample band where the model saw the rows."""
    r = F.abs(F.col(actual) - F.col(predicted))
    return df.where(finite(r)).agg(F.percentile(r, share).alias("half_width"), F.count("*").alias("n"))
