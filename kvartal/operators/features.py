"""Features of cells and of cell-months that see nothing of the month itself or later."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.constants import CITY_CENTRE, LAND, NODES, REDEVELOPMENT, STATION_COUNT_KM, STATIONS, TREATMENT
from kvartal.functions.geo import haversine_km
from kvartal.operators.panel import calendar_lag, momentum, month_index, target_encoding

MASTERPLAN = ["dist_centre_km", *[f"dist_node_{n}_km" for n in NODES], "dist_nearest_node_km", "node_gravity", "in_redev_zone"]
METRO = ["dist_metro_km", "dist_treatment_km", "n_stations_2km"]
PANEL_FEATURES = ["month_ix", "lag_own_1m", "lag_own_3m", "mom_3m", "nbr_price_prev_month", "new_share_prev_month", "n_listings_prev_month"]
FEATURES = [*MASTERPLAN, *METRO, *PANEL_FEATURES]


def distance_to(lat: Column, lon: Column, point: tuple[float, float]) -> Column:
    return haversine_km(lat, lon, F.lit(float(point[0])), F.lit(float(point[1])))


def nearest_of(lat: Column, lon: Column, points: list[tuple[float, float]]) -> Column:
    """Distance in km to the nearest of a fixed list of points; infinite for none."""
    if not points:
        return F.lit(float("inf"))
    each = [distance_to(lat, lon, p) for p in points]
    return each[0] if len(each) == 1 else F.least(*each)


def in_circles(lat: Column, lon: Column, circles: list[tuple[float, float, float]]) -> Column:
    """Whether a point lies in any circle (lat, lon, km)."""
    out = F.lit(False)
    for y, x, r in circles:
        out = out | (distance_to(lat, lon, (y, x)) <= r)
    return out


def masterplan_features(centres: DataFrame) -> DataFrame:
    """Twelve static columns for each cell of (h3, lat, lon): distances to the centre and the nodes, gravity, zones."""
    lat, lon = F.col("lat"), F.col("lon")
    nodes = {f"dist_node_{n}_km": distance_to(lat, lon, p) for n, p in NODES.items()}
    base = centres.dropDuplicates(["h3"]).select("h3", distance_to(lat, lon, CITY_CENTRE).alias("dist_centre_km"), *[d.alias(n) for n, d in nodes.items()], in_circles(lat, lon, list(REDEVELOPMENT.values())).cast("long").alias("in_redev_zone"))
    near = F.least(*nodes)
    return base.withColumn("dist_nearest_node_km", near).withColumn("node_gravity", 1 / (1 + near)).select("h3", *MASTERPLAN)


def station_table(spark) -> DataFrame:
    return spark.createDataFrame(STATIONS, "name string, s_lat double, s_lon double, opened string, planned string")


def metro_features(centres: DataFrame, months: DataFrame, include_planned: bool = False) -> DataFrame:
    """(h3, month) with distance to the nearest open station, to the treatment station, and stations within 2 km, as of each month.

    All months in one join against the fixed list of stations; a planned
    opening counts only for stations that have not opened.
    """
    stations = F.broadcast(station_table(centres.sparkSession))  # a fixed list
    open_by = F.col("opened") <= F.col("month")
    if include_planned:
        open_by = F.coalesce(open_by, F.col("planned") <= F.col("month"))
    grid = centres.dropDuplicates(["h3"]).select("h3", "lat", "lon").crossJoin(F.broadcast(months.select("month").distinct()))  # the calendar's months
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    treated = next((y, x) for n, y, x, *_ in STATIONS if n == TREATMENT)
    joined = grid.join(stations, open_by, "left").withColumn("km", km)
    return joined.groupBy("h3", "month", "lat", "lon").agg(
        F.coalesce(F.min("km"), F.lit(float("inf"))).alias("dist_metro_km"), F.coalesce(F.sum(F.when(F.col("km") <= STATION_COUNT_KM, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_stations_2km")
    ).select("h3", "month", "dist_metro_km", distance_to(F.col("lat"), F.col("lon"), treated).alias("dist_treatment_km"), "n_stations_2km")


def feature_matrix(panel: DataFrame, centres: DataFrame, edges: DataFrame, include_planned: bool = False) -> DataFrame:
    """Panel with its 22 feature columns, for cell-months whose previous calendar month was observed."""
    if set(FEATURES) & set(panel.columns):
        raise ValueError("panel already has feature columns")
    price = "price_azn_m2_median"
    out = calendar_lag(panel, {price: "lag_own_1m", "new_share": "new_share_prev_month", "n_listings": "n_listings_prev_month"}, 1)
    out = out.where(F.col("lag_own_1m").isNotNull())
    # Later lags look up the whole panel, not the rows kept.
    from kvartal.functions.moments import month_number, month_text

    for months, name in ((3, "lag_own_3m"), (4, "_lag4")):
        back = panel.select("h3", month_text(month_number(F.col("month")) + months).alias("month"), F.col(price).alias(name))
        out = out.join(back, ["h3", "month"], "left")
    around = target_encoding(panel, edges, price, "nbr_price_prev_month").select("h3", "month", "nbr_price_prev_month")
    out = out.withColumn("mom_3m", momentum(F.col("lag_own_1m"), F.col("_lag4"))).drop("_lag4").join(around, ["h3", "month"], "left")
    out = out.join(F.broadcast(month_index(panel)), "month")  # the calendar's months
    own = out.select("h3").distinct().join(centres.dropDuplicates(["h3"]), "h3")
    out = out.join(masterplan_features(own), "h3", "left")
    return out.join(metro_features(own, out.select("month"), include_planned), ["h3", "month"], "left").select(*panel.columns, *FEATURES)


def on_land(lat: Column, lon: Column) -> Column:
    """Even-odd test of a point against the fixed outline of the land."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(LAND, LAND[1:] + LAND[:1]):
        if y1 == y2:
            continue
        at = (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        crossings = crossings + F.when(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1


def land_cells(centres: DataFrame) -> DataFrame:
    """Cells whose centre is on land."""
    return centres.where(on_land(F.col("lat"), F.col("lon")))


def clip_ring(ring: list[tuple[float, float]], convex: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Part of a ring inside a convex ring, by cutting along each side in turn."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(convex, convex[1:] + convex[:1]))
    sides = convex if area > 0 else convex[::-1]
    out = list(ring)
    for (ax, ay), (bx, by) in zip(sides, sides[1:] + sides[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        points, out = out, []
        for p, q in zip(points, points[1:] + points[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp < 0) != (sq < 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return out


def cells_geojson(boxes: DataFrame, properties: DataFrame | None = None, clip: bool = True) -> DataFrame:
    """(h3, feature): a GeoJSON feature of each box, cut to the land, in [lon, lat] order with closed rings; empty ones are dropped."""
    import json

    import pandas as pd

    rows = boxes.select("h3", "lat_min", "lat_max", "lon_min", "lon_max")
    if properties is not None:
        rest = [c for c in properties.columns if c != "h3"]
        rows = rows.join(properties.select("h3", F.to_json(F.struct(*rest)).alias("props")), "h3")
    else:
        rows = rows.withColumn("props", F.lit("{}"))

    def make(batches):
        for pdf in batches:
            ids, out = [], []
            for r in pdf.itertuples(index=False):
                box = [(r.lon_min, r.lat_min), (r.lon_max, r.lat_min), (r.lon_max, r.lat_max), (r.lon_min, r.lat_max)]
                ring = clip_ring(LAND, box) if clip else box
                if len(ring) < 3 or math.isclose(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))), 0, abs_tol=1e-14):
                    continue
                ids.append(r.h3)
                out.append(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in [*ring, ring[0]]]]}, "properties": {"h3": r.h3, **json.loads(r.props)}}))
            yield pd.DataFrame({"h3": ids, "feature": out}, dtype=object)

    return rows.mapInPandas(make, "h3 string, feature string")
