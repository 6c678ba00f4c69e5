"""Spatial-lag ridge forecasts of dense log-price panels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.constants import HORIZONS
from kvartal.functions.moments import month_number, month_text

GAPS = ["g_own2", "g_own3", "g_nb1", "g_nb2", "g_nb3"]


def lag_gaps(filled: DataFrame, weights: DataFrame) -> DataFrame:
    """(h3, month_no, y, fresh, own1, gaps): lags of own and neighbours' log prices as gaps to the last own one.

    ``filled``: h3, month, log_obs, log_filled, observed, dense over months.
    A cell without neighbours takes its own value for theirs.
    """
    rows = filled.select("h3", month_number(F.col("month")).alias("t"), "log_obs", "log_filled", "observed")
    around = rows.select(F.col("h3").alias("dst"), "t", "log_filled").join(weights, "dst").groupBy(F.col("src").alias("h3"), "t").agg(F.sum(F.col("weight") * F.col("log_filled")).alias("nb"))
    rows = rows.join(around, ["h3", "t"], "left").withColumn("nb", F.coalesce("nb", "log_filled"))
    out = rows
    for k in (1, 2, 3):
        back = rows.select("h3", (F.col("t") + k).alias("t"), F.col("log_filled").alias(f"own{k}"), F.col("nb").alias(f"nb{k}"), F.col("observed").alias(f"seen{k}"))
        out = out.join(back, ["h3", "t"])
    gap = lambda c: F.col(c) - F.col("own1")
    return out.select(
        "h3", F.col("t").alias("month_no"), F.col("log_obs").alias("y"), (F.col("observed") & F.col("seen1")).alias("fresh"), "observed", "own1",
        gap("own2").alias("g_own2"), gap("own3").alias("g_own3"), gap("nb1").alias("g_nb1"), gap("nb2").alias("g_nb2"), gap("nb3").alias("g_nb3"),
    )


def fit_ridge(gaps: DataFrame, alpha: float = 1.0) -> tuple[float, np.ndarray]:
    """(drift, coefficients): median monthly increment of cells observed twice in a row, and ridge weights of the gaps for what remains.

    The five by five normal equations come from one aggregate.
    """
    rows = gaps.where("fresh")
    if rows.isEmpty():
        rows = gaps.where("observed")
    rows = rows.withColumn("inc", F.col("y") - F.col("own1"))
    drift = rows.agg(F.median("inc")).first()[0]
    if drift is None:
        raise ValueError("no observed months to fit on")
    r = F.col("inc") - F.lit(float(drift))
    terms = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}{j}") for i, a in enumerate(GAPS) for j, b in enumerate(GAPS)] + [F.sum(F.col(a) * r).alias(f"y{i}") for i, a in enumerate(GAPS)]
    s = rows.agg(*terms).first()
    xtx = np.array([[s[f"x{i}{j}"] for j in range(5)] for i in range(5)], dtype=float)
    return float(drift), np.linalg.solve(xtx + alpha * np.eye(5), np.array([s[f"y{i}"] for i in range(5)], dtype=float))


def ridge_forecast(filled: DataFrame, weights: DataFrame, horizons: tuple[int, ...] = HORIZONS, alpha: float = 1.0) -> DataFrame:
    """(h3, horizon_months, y_pred): prices rolled forward month by month.

    The state is three months of each cell and its sparse neighbour weights;
    cells are units of analysis, so the rollout runs on the driver.
    """
    if not horizons or min(horizons) < 1:
        raise ValueError("horizons must be at least 1")
    drift, beta = fit_ridge(lag_gaps(filled, weights), alpha)
    last = filled.agg(F.max(month_number(F.col("month")))).first()[0]
    tail = filled.where(month_number(F.col("month")) > last - 3).select("h3", (F.lit(last) - month_number(F.col("month"))).alias("k"), "log_filled").toPandas()
    wide = tail.pivot(index="h3", columns="k", values="log_filled").sort_index()
    cells = {c: i for i, c in enumerate(wide.index)}
    edges = weights.toPandas()
    edges = edges[edges["src"].isin(cells) & edges["dst"].isin(cells)]
    a, b, v = edges["src"].map(cells).to_numpy(dtype=int), edges["dst"].map(cells).to_numpy(dtype=int), edges["weight"].to_numpy(dtype=float)
    lone = np.ones(len(cells), dtype=bool)
    lone[a] = False

    def around(x: np.ndarray) -> np.ndarray:
        return np.where(lone, x, np.bincount(a, weights=v * x[b], minlength=len(x)))

    lags = [wide[k].to_numpy(dtype=float) for k in (0, 1, 2)]
    out = []
    for step in range(1, max(horizons) + 1):
        nb = [around(x) for x in lags]
        features = np.stack([lags[1] - lags[0], lags[2] - lags[0], nb[0] - lags[0], nb[1] - lags[0], nb[2] - lags[0]])
        lags = [lags[0] + drift + beta @ features, *lags[:2]]
        if step in horizons:
            out += [(c, step, float(p)) for c, p in zip(wide.index, np.exp(lags[0]))]
    return filled.sparkSession.createDataFrame(out, "h3 string, horizon_months int, y_pred double")


def next_month(month: str, k: int = 1):
    """The month ``k`` after ``month`` as a Column."""
    return month_text(month_number(F.lit(month)) + k)
