"""Implausible readings: spikes against low-rank daily profiles, stuck values, impossible values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from kvartal.functions.moments import local_day
from kvartal.operators.quantiles import exact_group_median
from kvartal.sources.tables import stored

RANK = 2
CELLS_PER_MATRIX = 256
BLOCK_ROWS = 1_000_000
BROADCAST_ROWS = 100_000


def robust_components(data: np.ndarray, seen: np.ndarray, rank: int = RANK, rounds: int = 60):
    """Robust principal components of a matrix with gaps: (column centres, row factors, column factors, sparse part).

    Principal component pursuit: the data minus column medians are split into a
    part of least nuclear norm and a sparse part, by augmented Lagrangian steps
    with shrunk singular values and shrunk residuals; what gaps hold is free.
    The low-rank part comes as its leading ``rank`` factors.
    """
    n, m = data.shape
    centre = np.array([np.median(data[seen[:, j], j]) if seen[:, j].any() else 0.0 for j in range(m)])
    d = np.where(seen, data - centre, 0.0)
    low, sparse = np.zeros_like(d), np.zeros_like(d)
    norm = float(np.sqrt(max(0.0, np.linalg.eigvalsh(d.T @ d)[-1])))
    if norm > 0:
        weight = 1 / np.sqrt(max(n, m) * seen.mean())
        mu, most = 1.25 / norm, 1e7 / norm
        dual = d / max(norm, np.abs(d).max() / weight)
        for _ in range(rounds):
            x = d - sparse + dual / mu
            squares, v = np.linalg.eigh(x.T @ x)
            sizes = np.sqrt(np.maximum(squares, 0))
            keep = sizes > 1 / mu
            v = v[:, keep]
            low = (x @ v) * ((sizes[keep] - 1 / mu) / sizes[keep]) @ v.T
            rest = d - low + dual / mu
            sparse = np.where(seen, np.sign(rest) * np.maximum(np.abs(rest) - weight / mu, 0), rest)
            gap = d - low - sparse
            dual += mu * gap
            mu = min(mu * 1.3, most)
            if np.linalg.norm(gap) <= 1e-6 * np.linalg.norm(d):
                break
    v = np.linalg.eigh(low.T @ low)[1][:, -max(1, min(rank, n, m)) :]
    return centre, low @ v, v, np.where(seen, sparse, 0.0)


def _usual(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries of a matrix with their usual log level, by at most CELLS_PER_MATRIX columns at a time."""
    days, i = np.unique(pdf["day"].to_numpy(), return_inverse=True)
    cells, j = np.unique(pdf["cell"].to_numpy().astype(str), return_inverse=True)
    usual = np.empty(len(pdf))
    for start in range(0, len(cells), CELLS_PER_MATRIX):
        own = np.flatnonzero((j >= start) & (j < start + CELLS_PER_MATRIX))
        rows, at = np.unique(i[own], return_inverse=True)
        data = np.zeros((len(rows), min(CELLS_PER_MATRIX, len(cells) - start)))
        seen = np.zeros(data.shape, dtype=bool)
        data[at, j[own] - start], seen[at, j[own] - start] = pdf["level"].to_numpy()[own], True
        centre, u, v, _ = robust_components(data, seen)
        usual[own] = (centre + u @ v.T)[at, j[own] - start]
    return pdf.assign(usual=usual)[["source", "field_name", "day", "cell", "low", "high", "usual"]]


def daily_profiles(long: DataFrame) -> DataFrame:
    """(source, field_name, day, cell, low, high, usual): the least and largest positive value of a day, and its usual log level.

    Each source's daily profiles, of mean log values, make matrices with a row
    per day and a column per cell; their low-rank part is the usual level.
    """
    entries = long.where("value > 0").groupBy("source", "field_name", "matrix", "day", "cell").agg(F.avg(F.ln("value")).alias("level"), F.min("value").alias("low"), F.max("value").alias("high"))
    return entries.groupBy("source", "field_name", "matrix").applyInPandas(_usual, "source string, field_name string, day int, cell string, low double, high double, usual double")


def spiked_days(profiles: DataFrame, medians: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(source, field_name, day, cell) whose sparse part may hold a value beyond the limit.

    The sparse part of a day is how far its least and largest values lie from
    the usual level.  A value beyond the limit is at least log(limit) from the
    log median, so it is at least that less the distance of usual level and
    median from the usual level: what this passes over holds no case.  Where
    the median is not positive every day is named.
    """
    slack = F.ln(_limit(limits)) - F.abs(F.col("usual") - F.ln("median")) - 1e-9
    spiked = (F.ln("high") - F.col("usual") >= slack) | (F.col("usual") - F.ln("low") >= slack) | (F.col("median") <= 0)
    return profiles.join(_small(medians), ["field_name", "cell"]).where(spiked).select("source", "field_name", "day", "cell")


def _limit(limits: dict[str, float]):
    limit = F.lit(None).cast("double")
    for name, ratio in limits.items():
        limit = F.when(F.col("field_name") == name, F.lit(float(ratio))).otherwise(limit)
    return limit


def _small(t: DataFrame) -> DataFrame:
    """``t``, broadcast if its rows, counted, are few."""
    return F.broadcast(t) if t.count() <= BROADCAST_ROWS else t


def constant_runs(long: DataFrame, least: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows in ``least`` or more successive rows, by ``row_no``, of one source, cell and field with the same value.

    Each series is cut into blocks of row numbers; runs that touch a block's
    end are chained over the blocks, of which each gives at most two.
    """
    key = ["field_name", "source", "cell"]
    in_block = w.Window.partitionBy(*key, "block").orderBy("row_no")
    runs = (
        long.select(*key, "row_no", "value", F.floor(F.col("row_no") / block_rows).alias("block"))
        .withColumn("before", F.lag("value").over(in_block))
        .withColumn("last", F.lead("value").over(in_block).isNull())
        .withColumn("run", F.sum(F.when(F.col("before") == F.col("value"), 0).otherwise(1)).over(in_block))
        .drop("before")
    )
    in_run = w.Window.partitionBy(*key, "block", "run")
    runs = runs.withColumn("n", F.count("*").over(in_run)).withColumn("ends", F.max("last").over(in_run))
    whole = runs.where(F.col("n") >= least)
    edge = (F.col("run") == 1) | F.col("ends")
    ends = runs.where(edge).groupBy(*key, "block", "run").agg(F.first("value").alias("value"), F.first("n").alias("n"), F.first("ends").alias("ends"))
    along = w.Window.partitionBy(*key).orderBy("block", "run")
    goes_on = (F.lag("value").over(along) == F.col("value")) & F.lag("ends").over(along) & (F.col("run") == 1)
    chains = (
        ends.withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("chain", F.sum("new").over(along))
        .withColumn("total", F.sum("n").over(w.Window.partitionBy(*key, "chain")))
        .where((F.col("total") >= least) & (F.col("n") < least))
        .select(*key, "block", "run")
    )
    parts = runs.where(edge & (F.col("n") < least)).join(chains, [*key, "block", "run"], "left_semi")
    return whole.select("row_no", "field_name").unionByName(parts.select("row_no", "field_name"))


def implausible_readings(df: DataFrame, limits: dict[str, float], cell: str = "h3", stuck_rows: int = 6) -> DataFrame:
    """Readings that can't be true: (``row_no``, ``field_name``), each once.

    ``limits`` gives, for each field, the ratio to the median of the cell from
    which a value counts as a spike.  A reading is named if it is zero or
    negative, if it is a spike, or if its feed keeps repeating it.

    Spikes are sought by robust principal components: each source's daily
    profiles (days by cells, of log values) are split into a low-rank usual
    level and a sparse part.  Only rows of :func:`spiked_days` are held against
    the exact median.  Constant runs and impossible values are tested apart.

    NULL and NaN readings are passed over.  NULL sources and cells form groups
    of their own; rows whose ``updated_at`` is missing or unreadable form a day
    of their own.  Repeated rows count as successive rows.  Ties at a limit are
    cases.  An empty table gives an empty result; other columns are ignored.
    """
    long = _long(df, list(limits), cell)
    medians = stored(exact_group_median(long, ["field_name", "cell"], "value"), "medians")
    days = stored(spiked_days(daily_profiles(long), medians, limits), "spiked-days")
    suspects = long.where("value > 0").join(_small(days), ["source", "field_name", "day", "cell"], "left_semi")
    limit = _limit(limits)
    beyond = (F.col("value") <= F.col("median") / limit) | (F.col("value") >= F.col("median") * limit)
    spikes = suspects.join(_small(medians), ["field_name", "cell"]).where(beyond).select("row_no", "field_name")
    impossible = long.where("value <= 0").select("row_no", "field_name")
    return spikes.unionByName(impossible).unionByName(constant_runs(long, stuck_rows)).distinct()


def _long(df: DataFrame, names: list[str], cell: str) -> DataFrame:
    """One row for each reading: row_no, source, cell, day, matrix, field_name, value."""
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    matrices = max(1, -(-2 * df.select(cell).distinct().count() // CELLS_PER_MATRIX))
    return (
        df.select(
            "row_no", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col(cell), F.lit("")).alias("cell"), F.coalesce(local_day(F.col("updated_at")), F.lit(-1)).alias("day"), *names
        )
        .select("row_no", "source", "cell", "day", F.pmod(F.xxhash64("cell"), F.lit(matrices)).cast("int").alias("matrix"), F.expr(f"stack({len(names)}, {pairs}) as (field_name, value)"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )
