"""Queries of an application over listings, cells and predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from kvartal.constants import CITY_CENTRE, LAND, NODES, SCENARIOS, STATIONS
from kvartal.functions.numeric import clip, finite, null_unless_finite, price_label, price_percentile, price_position, probability_label, signed_percent, width_label
from kvartal.operators.panel import last_observed, price_band, recent_momentum

METRICS = {"appreciation_pct": signed_percent, "q50": price_label, "current_price": price_label, "hotspot_prob": probability_label, "uncertainty": width_label}
SORTS = {
    "price_asc": ("price_azn", False), "price_desc": ("price_azn", True), "price_m2_asc": ("price_azn_m2", False), "price_m2_desc": ("price_azn_m2", True),
    "area_desc": ("area_m2", True), "score_desc": ("investment_score", True), "newest": ("listed_month", True),
}


def search(listings: DataFrame, district=None, rooms=None, building_type=None, price_min=None, price_max=None, area_min=None, area_max=None) -> DataFrame:
    """Listings by equality and range; a missing price or area counts as 0."""
    out = listings
    for column, value in (("district", district), ("rooms", rooms), ("building_type", building_type)):
        if value:
            out = out.where(F.col(column) == value)
    for column, low, high in (("price_azn", price_min, price_max), ("area_m2", area_min, area_max)):
        v = F.coalesce(F.col(column), F.lit(0.0))
        if low is not None:
            out = out.where(v >= low)
        if high is not None:
            out = out.where(v <= high)
    return out


def page(listings: DataFrame, sort: str = "score_desc", number: int = 1, per_page: int = 20, key: str = "listing_id") -> DataFrame:
    """One page in a sort order, ties by id, with ``page``, ``total`` and ``total_pages``; the page is kept within range."""
    if per_page < 1:
        raise ValueError("per_page must be at least 1")
    per_page = min(per_page, 100)
    total = listings.count()
    pages = max(1, math.ceil(total / per_page))
    number = max(1, min(number, pages))
    order = []
    if sort in SORTS:
        column, down = SORTS[sort]
        v = F.coalesce(F.col(column), F.lit("") if column == "listed_month" else F.lit(0))
        order.append(v.desc() if down else v.asc())
    rows = listings.orderBy(*order, key).offset((number - 1) * per_page).limit(per_page)
    return rows.withColumns({"page": F.lit(number), "total": F.lit(total), "total_pages": F.lit(pages)})


def by_id(listings: DataFrame, listing_id: str) -> DataFrame:
    return listings.where(F.col("listing_id") == listing_id)


def facets(listings: DataFrame) -> DataFrame:
    """One row: sorted distinct districts, and ranges of price and area."""
    known = F.when(F.col("district") != "", F.col("district"))
    return listings.agg(F.sort_array(F.collect_set(known)).alias("districts"), *[F.coalesce(f(c), F.lit(0.0)).alias(f"{c}_{n}") for c in ("price_azn", "area_m2") for n, f in (("min", F.min), ("max", F.max))])


def layer_values(predictions: DataFrame, panel: DataFrame, scenario: str, horizon: int, metric: str) -> DataFrame:
    """(h3, value, label) of a map layer; cells without a finite value are left out."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows = predictions.where((F.col("scenario") == scenario) & (F.col("horizon_months") == horizon))
    if rows.isEmpty():
        raise ValueError(f"no predictions for {scenario} at {horizon}")
    rows = rows.withColumn("_k", F.row_number().over(w.Window.partitionBy("h3").orderBy(F.desc("base_month")))).where("_k = 1")
    if metric == "current_price":
        rows = rows.select("h3").join(last_observed(panel), "h3", "left").select("h3", F.col("last_price").alias("value"))
    elif metric == "uncertainty":
        rows = rows.select("h3", (F.col("q90") - F.col("q10")).alias("value"))
    else:
        rows = rows.select("h3", F.col(metric).alias("value"))
    return rows.where(finite(F.col("value"))).withColumn("label", METRICS[metric](F.col("value")))


def colour_bounds(layer: DataFrame, metric: str) -> DataFrame:
    """One row (vmin, vmax): 5th and 95th percentile, [0, 1] for chances, symmetric for appreciation, widened where they meet."""
    if metric == "hotspot_prob":
        return layer.agg(F.lit(0.0).alias("vmin"), F.lit(1.0).alias("vmax"))
    s = layer.agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.avg("value").alias("m"))
    low, high = F.coalesce(F.col("p")[0], F.lit(0.0)), F.coalesce(F.col("p")[1], F.lit(1.0))
    if metric == "appreciation_pct":
        half = F.greatest(F.abs(low), F.abs(high))
        low, high = -half, half
    centre = F.coalesce("m", F.lit(0.0))
    pad = F.greatest(0.05 * F.abs(centre), F.lit(1.0))
    return s.select(F.when(low < high, low).otherwise(centre - pad).alias("vmin"), F.when(low < high, high).otherwise(centre + pad).alias("vmax"))


def zone_layer(values: DataFrame, zones: DataFrame, panel: DataFrame) -> DataFrame:
    """(zone, value): mean weighted by listings; plain where there are none."""
    weight = panel.groupBy("h3").agg(F.sum("n_listings").alias("w"))
    rows = zones.join(values.select("h3", "value"), "h3").join(weight, "h3", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    return rows.groupBy("zone").agg(F.when(F.sum("w") > 0, F.sum(F.col("value") * F.col("w")) / F.sum("w")).otherwise(F.avg("value")).alias("value"))


def cell_history(panel: DataFrame, cell: str) -> DataFrame:
    return panel.where(F.col("h3") == cell).orderBy("month")


def cell_forecast(predictions: DataFrame, cell: str) -> DataFrame:
    return predictions.where(F.col("h3") == cell).orderBy("scenario", "horizon_months")


def cell_bundle(panel: DataFrame, predictions: DataFrame) -> DataFrame:
    """(h3, history, forecast) as sorted arrays of structs."""
    history = panel.groupBy("h3").agg(F.sort_array(F.collect_list(F.struct("month", "price_azn_m2_median", "n_listings"))).alias("history"))
    ahead = predictions.groupBy("h3").agg(F.sort_array(F.collect_list(F.struct("scenario", "horizon_months", "q10", "q50", "q90"))).alias("forecast"))
    return history.join(ahead, "h3", "full")


def share_below(values: DataFrame, column: str, name: str) -> DataFrame:
    """``values`` with the share of its rows below each, in per cent; the table holds a row per cell."""
    order = w.Window.orderBy(column)
    return values.withColumn(name, (F.rank().over(order) - 1) / F.count("*").over(w.Window.partitionBy()) * 100)


def investment_score(appreciation: Column, price: Column, metro: Column, plan: Column, momentum: Column) -> Column:
    """Weighted mix of five scores of 0 to 100, rounded half to even."""
    raw = 0.30 * appreciation + 0.25 * price + 0.20 * metro + 0.15 * plan + 0.10 * momentum
    return clip(F.bround(raw, 0), 0, 100).cast("int")


def enrich(listings: DataFrame, panel: DataFrame, cell_features: DataFrame, predictions: DataFrame, cell: str = "cell") -> DataFrame:
    """Listings with position in their cell's band, the cell's figures and an investment score."""
    ahead = predictions.where(F.col("scenario") == "baseline")
    p12 = ahead.where("horizon_months = 12").select("h3", F.col("q50").alias("q50_12"), F.col("appreciation_pct").alias("appreciation_12m_pct"), "hotspot_prob")
    p24 = ahead.where("horizon_months = 24").select("h3", F.col("appreciation_pct").alias("appreciation_24m_pct"))
    facts = cell_features.select("h3", "dist_metro_km", "node_gravity", "dist_centre_km", "in_redev_zone")
    facts = share_below(share_below(facts, "dist_metro_km", "metro_pct"), "node_gravity", "gravity_pct")
    moves = share_below(recent_momentum(panel), "momentum_pct", "momentum_rank")
    cells = facts.join(price_band(panel), "h3", "full").join(last_observed(panel), "h3", "left").join(moves, "h3", "left").join(share_below(p12, "appreciation_12m_pct", "appr_rank"), "h3", "left").join(p24, "h3", "left")
    rows = listings.join(cells.withColumnRenamed("h3", cell), cell, "left")
    price = F.coalesce("price_azn_m2", F.lit(0.0))
    priced = F.when((F.col("q50_12") != 0) & (price > 0), clip(50 + (F.col("q50_12") - price) / F.col("q50_12") * 200, 0, 100)).otherwise(50.0)
    zero = lambda c, v=0.0: F.coalesce(F.col(c), F.lit(v))
    return rows.select(
        *listings.columns, "appreciation_12m_pct", "appreciation_24m_pct", "hotspot_prob", F.col("p10").alias("q10"), F.col("last_price").alias("q50"), F.col("p90").alias("q90"),
        price_position(price, F.col("p10"), F.col("p90"), F.col("last_price")).alias("price_position"), F.bround(price_percentile(price, F.col("p10"), F.col("p90")), 1).alias("price_percentile"),
        F.bround("dist_metro_km", 2).alias("dist_metro_km"), F.bround("node_gravity", 3).alias("node_gravity"), F.bround(zero("momentum_pct"), 1).alias("momentum_3m_pct"),
        investment_score(zero("appr_rank"), priced, 100 - zero("metro_pct", 100.0), zero("gravity_pct"), zero("momentum_rank")).alias("investment_score"),
    )


def plain_output(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as NULL, for JSON."""
    return df.select(*[null_unless_finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def photo_choice(listing_id: Column, photos: Column) -> Column:
    """One photo of a pool, always the same for a listing."""
    return F.when(F.size(photos) > 0, F.element_at(photos, (F.pmod(F.xxhash64(listing_id), F.size(photos)) + 1).cast("int")))


def stations(spark: SparkSession) -> DataFrame:
    """(name, lat, lon, opened, planned) of the stations."""
    return spark.createDataFrame(STATIONS, "name string, lat double, lon double, opened string, planned string")


def nodes(spark: SparkSession) -> DataFrame:
    """(name, lat, lon) of the polycentric nodes."""
    return spark.createDataFrame([(n, y, x) for n, (y, x) in NODES.items()], "name string, lat double, lon double")


def configuration() -> dict:
    """Centre, bounds of the land, scenarios, metrics and nodes, as an application asks for them."""
    xs, ys = zip(*LAND)
    return {
        "centre": list(CITY_CENTRE), "bounds": {"lat_min": min(ys), "lat_max": max(ys), "lon_min": min(xs), "lon_max": max(xs)}, "scenarios": list(SCENARIOS), "metrics": list(METRICS),
        "nodes": [{"name": n, "lat": y, "lon": x} for n, (y, x) in NODES.items()],
    }
