"""Difference in differences around an opening, from aggregated normal equations."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.constants import BUFFER_KM, CONTROL_MAX_KM, STATIONS, TREATMENT, TREATMENT_RADIUS_KM, Z95
from kvartal.functions.moments import month_number
from kvartal.operators.features import distance_to

COVARIATES = ["rooms", "area_m2", "floor", "is_new"]


def station(name: str = TREATMENT) -> tuple[float, float, str]:
    """(lat, lon, opening month) of a station, the planned month where it has not opened."""
    for n, y, x, opened, planned in STATIONS:
        if n == name:
            if opened or planned:
                return y, x, opened or planned
            raise ValueError(f"{name} has no opening month")
    raise ValueError(f"unknown station {name}")


def did_frame(listings: DataFrame, name: str = TREATMENT, radius_km: float = TREATMENT_RADIUS_KM, buffer_km: float = BUFFER_KM, control_max_km: float = CONTROL_MAX_KM) -> DataFrame:
    """Treated listings within the radius and controls in the outer ring, with distance, ``treated``, ``rel_month``, ``post``, ``log_price``, ``is_new``."""
    y, x, opened = station(name)
    number = int(opened[:4]) * 12 + int(opened[5:])
    d = F.col("dist_treatment_km")
    out = listings.withColumn("dist_treatment_km", distance_to(F.col("lat"), F.col("lon"), (y, x)))
    out = out.where((d <= radius_km) | ((d > buffer_km) & (d <= control_max_km)))
    rel = month_number(F.col("listed_month")) - number
    return out.withColumn("treated", d <= radius_km).withColumn("rel_month", rel.cast("long")).withColumn("post", rel >= 0).withColumn("log_price", F.ln("price_azn_m2")).withColumn("is_new", F.when(F.col("building_type") == "new", 1).otherwise(0).cast("long"))


@dataclass
class Estimate:
    """Coefficients and cluster-robust standard errors of the named terms."""

    coef: dict[str, float]
    se: dict[str, float]
    rows: int
    clusters: int
    rank: int


def fixed_effects_ols(frame: DataFrame, target: str, terms: list[str], covariates: list[str], cell: str = "cell", month: str = "listed_month") -> Estimate:
    """OLS of ``target`` on terms and covariates with fixed effects of cell and month, errors clustered by cell.

    Rows are only summed by (cell, month): counts, sums and cross products.
    The sums, bounded by cells times months, give the normal equations of the
    full dummy design on the driver, and the scores of each cell give the
    clustered covariance, with the usual correction for few clusters.
    """
    x = [*terms, *covariates]
    cols = [*x, target]
    row = frame.where(" and ".join(f"`{c}` is not null" for c in [*cols, cell, month])).select(cell, month, *[F.col(c).cast("double").alias(c) for c in cols])
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    agg = row.groupBy(F.col(cell).alias("g"), F.col(month).alias("m")).agg(F.count("*").alias("n"), *sums, *cross).toPandas()
    if agg.empty:
        raise ValueError("no rows to fit")
    k = len(x)
    cells, gi = np.unique(agg["g"].to_numpy().astype(str), return_inverse=True)
    months, mi = np.unique(agg["m"].to_numpy().astype(str), return_inverse=True)
    g, m = len(cells), len(months)
    size = k + m + g
    n = agg["n"].to_numpy(dtype=float)
    s = agg[[f"s{i}" for i in range(k + 1)]].to_numpy(dtype=float)
    c = np.zeros((len(agg), k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            c[:, i, j] = c[:, j, i] = agg[f"c{i}_{j}"].to_numpy(dtype=float)
    xtx, xty = np.zeros((size, size)), np.zeros(size)
    xtx[:k, :k], xty[:k] = c[:, :k, :k].sum(axis=0), c[:, :k, k].sum(axis=0)
    mcol, gcol = k + mi, k + m + gi
    for i in range(k):
        np.add.at(xtx[i], mcol, s[:, i])
        np.add.at(xtx[i], gcol, s[:, i])
    np.add.at(xtx, (mcol, mcol), n)
    np.add.at(xtx, (gcol, gcol), n)
    np.add.at(xtx, (mcol, gcol), n)
    xtx = np.triu(xtx) + np.triu(xtx, 1).T
    np.add.at(xty, mcol, s[:, k])
    np.add.at(xty, gcol, s[:, k])
    values, vectors = np.linalg.eigh(xtx)
    keep = values > values.max() * 1e-11
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    beta = inverse @ xty
    # Scores of a cell: its rows' regressors times residuals, summed from the same sums.
    effect = beta[mcol] + beta[gcol]
    rest = s[:, k] - s[:, :k] @ beta[:k] - n * effect
    score = np.zeros((g, size))
    own = c[:, :k, k] - np.einsum("rij,j->ri", c[:, :k, :k], beta[:k]) - s[:, :k] * effect[:, None]
    np.add.at(score, (gi[:, None], np.arange(k)[None, :]), own)
    np.add.at(score, (gi, mcol), rest)
    np.add.at(score, (gi, gcol), rest)
    rows, rank = float(n.sum()), int(keep.sum())
    fix = g / max(1, g - 1) * (rows - 1) / max(1.0, rows - rank)
    cov = fix * inverse @ (score.T @ score) @ inverse
    return Estimate({t: float(beta[i]) for i, t in enumerate(x)}, {t: float(math.sqrt(max(0.0, cov[i, i]))) for i, t in enumerate(x)}, int(rows), g, rank)


def _p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def spatial_did(frame: DataFrame, cell: str = "cell", covariates: list[str] | None = None) -> DataFrame:
    """One row: effect of the opening on treated listings in logs and per cent, standard error, p value, interval, numbers of listings."""
    counts = {r["treated"]: r["count"] for r in frame.groupBy("treated").count().collect()}
    if not counts.get(True) or not counts.get(False):
        raise ValueError("needs treated and control listings")
    est = fixed_effects_ols(frame.withColumn("treated_post", (F.col("treated") & F.col("post")).cast("int")), "log_price", ["treated_post"], covariates or COVARIATES, cell)
    b, se = est.coef["treated_post"], est.se["treated_post"]
    row = (b, 100 * (math.exp(b) - 1), se, _p_value(b / se) if se else None, b - Z95 * se, b + Z95 * se, counts[True], counts[False])
    return frame.sparkSession.createDataFrame([row], "att_log double, att_pct double, se double, p_value double, ci_low double, ci_high double, n_treated long, n_control long")


def event_study(frame: DataFrame, window: tuple[int, int] = (-12, 14), base: int = -1, cell: str = "cell", covariates: list[str] | None = None) -> DataFrame:
    """(rel_month, coef, se, ci_low, ci_high, n) around the opening, against the month before it; months outside the window are dropped."""
    low, high = window
    if not low <= base <= high:
        raise ValueError("window must hold the base month")
    inside = frame.where(F.col("rel_month").between(low, high))
    counts = {r["rel_month"]: r["count"] for r in inside.where("treated").groupBy("rel_month").count().collect()}
    if not counts.get(base):
        raise ValueError("no treated listings in the base month")
    names = {k: f"ev_{'m' if k < 0 else 'p'}{abs(k):02d}" for k in range(low, high + 1) if k != base and counts.get(k)}
    for k, name in names.items():
        inside = inside.withColumn(name, (F.col("treated") & (F.col("rel_month") == k)).cast("int"))
    est = fixed_effects_ols(inside, "log_price", list(names.values()), covariates or COVARIATES, cell)
    rows = [(base, 0.0, 0.0, 0.0, 0.0, counts[base])]
    rows += [(k, est.coef[v], est.se[v], est.coef[v] - Z95 * est.se[v], est.coef[v] + Z95 * est.se[v], counts[k]) for k, v in names.items()]
    return frame.sparkSession.createDataFrame(pd.DataFrame(sorted(rows), columns=["rel_month", "coef", "se", "ci_low", "ci_high", "n"]))
