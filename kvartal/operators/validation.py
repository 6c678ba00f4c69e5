"""Splits in time and space, and measures of fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.constants import MIN_TRAIN_MONTHS, SPATIAL_FOLDS
from kvartal.functions.numeric import finite


def walk_forward_splits(months: list[str], min_train: int = MIN_TRAIN_MONTHS, test_size: int = 1, step: int = 1) -> list[tuple[list[str], list[str]]]:
    """(train months, test months) with an expanding window; every train month is before every test month, and the last month is covered."""
    if min(min_train, test_size, step) < 1:
        raise ValueError("sizes must be at least 1")
    ordered = sorted(set(months))
    if len(ordered) <= min_train:
        raise ValueError(f"need more than {min_train} months, got {len(ordered)}")
    out = [(ordered[:a], ordered[a : a + test_size]) for a in range(min_train, len(ordered), step)]
    if out[-1][1][-1] != ordered[-1]:
        a = max(min_train, len(ordered) - test_size)
        out.append((ordered[:a], ordered[a:]))
    return out


def split_table(spark: SparkSession, splits: list[tuple[list[str], list[str]]]) -> DataFrame:
    """(split, month, role) of splits."""
    rows = [(i, m, role) for i, (train, test) in enumerate(splits) for role, ms in (("train", train), ("test", test)) for m in ms]
    return spark.createDataFrame(rows, "split int, month string, role string")


def block_folds(cells: DataFrame, block: Column, folds: int = SPATIAL_FOLDS, seed: int | None = None) -> DataFrame:
    """(h3, fold): whole blocks to folds, the largest first, each to the smallest fold so far.

    Ties go by a hash of block and ``seed``, or by the block's name without
    one.  The driver sees the blocks, of which there are tens.
    """
    if folds < 1:
        raise ValueError("folds must be at least 1")
    tagged = cells.dropDuplicates(["h3"]).withColumn("block", block).select("h3", "block")
    tie = F.col("block") if seed is None else F.xxhash64("block", F.lit(seed))
    blocks = tagged.groupBy("block").agg(F.count("*").alias("n")).orderBy(F.desc("n"), tie).collect()
    if not blocks:
        raise ValueError("no cells")
    sizes, rows = [0] * folds, []
    for r in blocks:
        k = min(range(folds), key=lambda i: (sizes[i], i))
        rows.append((r["block"], k))
        sizes[k] += r["n"]
    plan = cells.sparkSession.createDataFrame(rows, "block string, fold int")
    return tagged.join(F.broadcast(plan), "block").select("h3", "fold")  # one row per block


def metric_columns(actual: str, predicted: str) -> list[Column]:
    """mae, mape, r2 and n of rows with finite values: MAPE passes over targets of zero, R2 needs two rows and some variance."""
    ok = finite(F.col(actual)) & finite(F.col(predicted))
    y, p = F.when(ok, F.col(actual)), F.when(ok, F.col(predicted))
    n = F.count(y)
    spread = F.var_pop(y) * n
    return [
        F.avg(F.abs(y - p)).alias("mae"),
        (F.avg(F.when(y != 0, F.abs((y - p) / y))) * 100).alias("mape"),
        F.when((n >= 2) & (spread > 0), 1 - F.sum((y - p) * (y - p)) / spread).alias("r2"),
        n.alias("n"),
    ]


def metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Measures of fit, by groups or over all rows (pooled, not averaged over groups)."""
    return (df.groupBy(*by) if by else df.groupBy()).agg(*metric_columns(actual, predicted))


def pooled_and_split(df: DataFrame, actual: str, predicted: str, split: str) -> DataFrame:
    """Measures for each split, and pooled with NULL split, in one pass."""
    return df.rollup(split).agg(*metric_columns(actual, predicted))


def skill(own: Column, naive: Column) -> Column:
    """Gain over the naive error."""
    return F.when(naive > 0, 1 - own / naive)
