"""Trends of cells, scenario adjustments, and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from kvartal.constants import SCENARIOS, STATIONS, TREATMENT, TREATMENT_RADIUS_KM, Z80
from kvartal.functions.moments import month_number
from kvartal.functions.numeric import clip, normal_cdf
from kvartal.operators.features import distance_to


def trend_slopes(panel: DataFrame, months: int = 22, least: int = 8, price: str = "price_azn_m2_median") -> DataFrame:
    """(h3, slope, n): log trend per panel month of each cell over the last ``months`` panel months but the first, of cells observed ``least`` times."""
    index = panel.select("month").distinct().select("month", F.row_number().over(w.Window.orderBy(F.desc("month"))).alias("k"), F.count("*").over(w.Window.partitionBy()).alias("all"))  # the calendar's months
    kept = index.where(F.col("k") <= F.least(F.lit(months), F.col("all") - 1)).select("month", (-F.col("k")).alias("t"))
    rows = panel.where(F.col(price) > 0).join(F.broadcast(kept), "month")
    return rows.groupBy("h3").agg(F.regr_slope(F.ln(price), F.col("t").cast("double")).alias("slope"), F.count("*").alias("n")).where(F.col("n") >= least)


def weighted_slope(df: DataFrame, y: str, x: str, weight: str) -> DataFrame:
    """One row: slope of y on x by weighted least squares."""
    v, a, b = F.col(weight), F.col(x), F.col(y)
    s = df.where(a.isNotNull() & b.isNotNull()).agg(F.sum(v).alias("w"), F.sum(v * a).alias("wx"), F.sum(v * b).alias("wy"), F.sum(v * a * a).alias("wxx"), F.sum(v * a * b).alias("wxy"), F.count("*").alias("cells"))
    down = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    return s.select(F.when(down != 0, (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / down).alias("slope"), "cells")


def gravity_slope(panel: DataFrame, gravity: DataFrame, least_cells: int = 20) -> DataFrame:
    """One row: extra log trend for a unit of gravity, never below zero; zero with too few cells or fewer than 14 months."""
    slopes = trend_slopes(panel).withColumnRenamed("slope", "trend").join(gravity.select("h3", "node_gravity"), "h3", "left")
    months = panel.select(F.countDistinct("month").alias("months"))
    fit = weighted_slope(slopes, "trend", "node_gravity", "n").crossJoin(months)  # one row each
    return fit.select(F.when((F.col("months") >= 14) & (F.col("cells") >= least_cells), F.greatest(F.col("slope"), F.lit(0.0))).otherwise(0.0).alias("gravity_slope"))


def next_station() -> tuple[float, float]:
    """The point as far beyond the treated station as the station before it lies behind."""
    at = {n: (y, x) for n, y, x, *_ in STATIONS}
    a, b = at[TREATMENT], at["8 Noyabr"]
    return 2 * a[0] - b[0], 2 * a[1] - b[1]


def transit_ramp(horizon: Column) -> Column:
    """Share of the transit effect that a horizon has seen: from month six, in full after three."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (horizon - 6) / 3.0))


def scenario_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SCENARIOS.items()], "scenario string, pull double, transit boolean")


def adjustment(pull: Column, transit: Column, horizon: Column, gravity: Column, slope: Column, att: Column, lat: Column, lon: Column) -> Column:
    """Log adjustment of a scenario on a cell's forecast."""
    near = distance_to(lat, lon, next_station()) <= TREATMENT_RADIUS_KM
    return (pull - 1) * slope * horizon * F.coalesce(gravity, F.lit(0.0)) + F.when(transit & near & (att > 0), att * transit_ramp(horizon)).otherwise(0.0)


def predictions(forecast: DataFrame, centres: DataFrame, gravity: DataFrame, widths: DataFrame, base: DataFrame, slope: DataFrame, att: float, base_month: str, power: float = 0.2) -> DataFrame:
    """Forecast of every cell, scenario and horizon with interval, appreciation on the last price, and chance to beat the median cell.

    ``widths``: h3, rel_lo, rel_hi relative half widths at the last month;
    cells without take the median.  They grow with horizon ** ``power``.
    """
    floor = lambda c: F.greatest(F.col(c), F.lit(0.01))
    own = widths.select("h3", F.when(F.col("rel_lo").isNotNull(), floor("rel_lo")).alias("rel_lo"), F.when(F.col("rel_hi").isNotNull(), floor("rel_hi")).alias("rel_hi"))
    usual = own.agg(F.median("rel_lo").alias("mid_lo"), F.median("rel_hi").alias("mid_hi"))
    few = forecast.crossJoin(F.broadcast(scenario_table(forecast.sparkSession))).crossJoin(F.broadcast(usual)).crossJoin(F.broadcast(slope))  # three rows, one, one
    rows = few.join(centres.select("h3", "lat", "lon"), "h3").join(gravity.select("h3", "node_gravity"), "h3", "left").join(own, "h3", "left").join(base.select("h3", F.col("last_price").alias("base")), "h3", "left")
    h = F.col("horizon_months")
    adj = adjustment(F.col("pull"), F.col("transit"), h, F.col("node_gravity"), F.col("gravity_slope"), F.lit(float(att)), F.col("lat"), F.col("lon"))
    scale = F.pow(h.cast("double"), F.lit(power))
    rows = rows.withColumn("q50", F.col("y_pred") * F.exp(adj)).where(F.col("q50").isNotNull())
    rows = rows.withColumn("q10", F.col("q50") * F.greatest(1 - F.coalesce("rel_lo", "mid_lo") * scale, F.lit(0.05))).withColumn("q90", F.col("q50") * (1 + F.coalesce("rel_hi", "mid_hi") * scale))
    rows = rows.withColumn("app", (F.col("q50") / F.col("base") - 1) * 100).withColumn("sigma", (F.col("q90") - F.col("q10")) / F.col("base") * 100 / (2 * Z80))
    middle = rows.groupBy("scenario", "horizon_months").agg(F.median("app").alias("mid"))
    rows = rows.join(F.broadcast(middle), ["scenario", "horizon_months"])  # one row per scenario and horizon
    hot = 1 - normal_cdf((F.col("mid") - F.col("app")) / F.greatest(F.col("sigma"), F.lit(1e-6)))
    return rows.select("h3", F.lit(base_month).alias("base_month"), h.cast("long").alias("horizon_months"), "scenario", "q10", "q50", "q90", F.col("app").alias("appreciation_pct"), hot.alias("hotspot_prob"))


def snapshot_projection(cells: DataFrame, base_month: str) -> DataFrame:
    """Predictions of a single snapshot from gravity alone: h3, node_gravity, q10, q50, q90 to both horizons."""
    grid = cells.withColumn("horizon_months", F.explode(F.array(F.lit(12), F.lit(24))))
    app = F.coalesce("node_gravity", F.lit(0.0)) * 5 * F.when(F.col("horizon_months") == 24, 1.8).otherwise(1.0)
    rows = grid.withColumn("a", app)
    return rows.select(
        "h3", F.lit(base_month).alias("base_month"), F.col("horizon_months").cast("long").alias("horizon_months"), F.lit("baseline").alias("scenario"), (F.col("q10") * (1 + F.col("a") / 100 * 0.5)).alias("q10"),
        (F.col("q50") * (1 + F.col("a") / 100)).alias("q50"), (F.col("q90") * (1 + F.col("a") / 100 * 1.5) * F.sqrt(F.col("horizon_months") / 12)).alias("q90"), F.col("a").alias("appreciation_pct"), normal_cdf(F.col("a") / 5).alias("hotspot_prob"),
    )


def opening_ramp(rel_month: Column, months: int = 3) -> Column:
    """Share of an opening's effect: none before, rising over ``months``."""
    return F.when(rel_month < 0, 0.0).otherwise(clip((rel_month + 1) / float(months), 0, 1))


def last_month_number(panel: DataFrame) -> int:
    return panel.agg(F.max(month_number(F.col("month")))).first()[0]
