"""Queries of the market analysis over whole tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.constants import LAND, NODES, REDEVELOPMENT, SCENARIOS, STATIONS
from kvartal.functions.moments import month_number
from kvartal.functions.numeric import normal_cdf
from kvartal.functions.parsing import first_number, flatten_node, floor_pair, listed_month, normalise_nodes, phash_hamming
from kvartal.operators import causal, features, graph, intervals, panel as panels, resolve, scenario, serving, study, validation
from kvartal.operators.quantiles import exact_group_median
from kvartal.operators.tessellation import HexGrid, assign_boxes, kd_block
from kvartal.sources.tables import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines give the same value."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- tables that several queries share

FLATS = """flats AS (
  SELECT row_no, listing_id, source, h3, listed_month, price_azn_m2, area AS area_m2, price_azn_m2 * area AS price_azn, lat, lon, rooms, floor,
         floors AS building_floors, building_type, image_phash, location_name AS district
  FROM listings WHERE price_azn_m2 > 0 AND listed_month IS NOT NULL)"""
PANEL = FLATS + """, pan AS (
  SELECT h3, listed_month AS month, median(price_azn_m2) AS p, avg(price_azn_m2) AS mean, count(*) AS n,
         avg(CASE WHEN building_type = 'new' THEN 1.0 ELSE 0.0 END) AS new_share,
         substr(listed_month, 1, 4)::INT * 12 + substr(listed_month, 6, 2)::INT AS t
  FROM flats GROUP BY h3, listed_month HAVING count(*) >= 3)"""
CENTRES = "mid AS (SELECT h3, (lat_min + lat_max) / 2 AS lat, (lon_min + lon_max) / 2 AS lon FROM cells)"
EDGES = """edges AS (
  SELECT a.h3 AS src, b.h3 AS dst FROM cells a JOIN cells b ON a.h3 <> b.h3
  WHERE (least(a.lat_max, b.lat_max) - greatest(a.lat_min, b.lat_min) > 1e-9 AND abs(least(a.lon_max, b.lon_max) - greatest(a.lon_min, b.lon_min)) <= 1e-9)
     OR (least(a.lon_max, b.lon_max) - greatest(a.lon_min, b.lon_min) > 1e-9 AND abs(least(a.lat_max, b.lat_max) - greatest(a.lat_min, b.lat_min)) <= 1e-9))"""


def km(lat1: str, lon1: str, lat2, lon2) -> str:
    """SQL of a great-circle distance."""
    return (
        f"(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def flats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings rows with a positive price per square metre and a month, under the names of the listings contract."""
    rows = table(spark, sf_dir, "listings").where("price_azn_m2 > 0 AND listed_month IS NOT NULL")
    return rows.select(
        "row_no", "listing_id", "source", "h3", "listed_month", "price_azn_m2", F.col("area").alias("area_m2"), (F.col("price_azn_m2") * F.col("area")).alias("price_azn"), "lat", "lon", "rooms", "floor",
        F.col("floors").alias("building_floors"), "building_type", "image_phash", F.col("location_name").alias("district"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel, written once: queries look it up many times, and it has a row per cell and month only."""
    return stored(panels.build_panel(flats(spark, sf_dir)), "panel")


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cells").select("h3", ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"), ((F.col("lon_min") + F.col("lon_max")) / 2).alias("lon"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.box_edges(table(spark, sf_dir, "cells"))


# ---------------------------------------------------------------- panel and months


@query(f"WITH {PANEL} SELECT h3, month, round(p, 6) AS price_azn_m2_median, round(mean, 6) AS price_azn_m2_mean, n AS n_listings, round(new_share, 6) AS new_share FROM pan")
def panel_cell_month(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


@query(f"""WITH {PANEL}, span AS (SELECT unnest(generate_series(min(t), max(t))) AS t FROM pan), months AS (SELECT t, printf('%04d-%02d', (t - 1) // 12, (t - 1) % 12 + 1) AS month FROM span)
SELECT c.h3, m.month, round(p, 6) AS price_azn_m2_median, coalesce(n, 0) AS n_listings, round(new_share, 6) AS new_share
FROM (SELECT DISTINCT h3 FROM pan) c CROSS JOIN months m LEFT JOIN pan USING (h3, month)""")
def panel_complete(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(panels.complete_panel(p, panels.month_span(p)).select("h3", "month", "price_azn_m2_median", "n_listings", "new_share"))


@query(f"""WITH {PANEL} SELECT a.h3, a.month, round(b.p, 6) AS lag_1, round(c.p, 6) AS lag_3, round(b.new_share, 6) AS new_share_prev, b.n AS n_prev
FROM pan a LEFT JOIN pan b ON a.h3 = b.h3 AND b.t = a.t - 1 LEFT JOIN pan c ON a.h3 = c.h3 AND c.t = a.t - 3""")
def lag_calendar(spark, sf_dir):
    p = panel(spark, sf_dir)
    one = panels.calendar_lag(p, {"price_azn_m2_median": "lag_1", "new_share": "new_share_prev", "n_listings": "n_prev"}, 1)
    three = panels.calendar_lag(p, {"price_azn_m2_median": "lag_3"}, 3).select("h3", "month", "lag_3")
    return rounded(one.join(three, ["h3", "month"]).select("h3", "month", "lag_1", "lag_3", "new_share_prev", "n_prev"))


@query(f"WITH {PANEL} SELECT a.h3, a.month, round((b.p - c.p) / c.p * 100, 6) AS mom_3m FROM pan a JOIN pan b ON a.h3 = b.h3 AND b.t = a.t - 1 JOIN pan c ON a.h3 = c.h3 AND c.t = a.t - 4")
def momentum_3m(spark, sf_dir):
    p = panel(spark, sf_dir)
    one = panels.calendar_lag(p, {"price_azn_m2_median": "l1"}, 1)
    four = panels.calendar_lag(p, {"price_azn_m2_median": "l4"}, 4).select("h3", "month", "l4")
    return rounded(one.join(four, ["h3", "month"]).select("h3", "month", panels.momentum(F.col("l1"), F.col("l4")).alias("mom_3m")).where("mom_3m is not null"))


@query(f"WITH {PANEL} SELECT DISTINCT month, dense_rank() OVER (ORDER BY month) - 1 AS month_ix FROM pan")
def month_index(spark, sf_dir):
    return panels.month_index(panel(spark, sf_dir))


@query(f"WITH {FLATS} SELECT substr(listed_month, 1, 4)::BIGINT * 12 + substr(listed_month, 6, 2)::BIGINT - (2025 * 12 + 6) AS rel_month, count(*) AS n FROM flats GROUP BY 1")
def rel_month(spark, sf_dir):
    return flats(spark, sf_dir).groupBy((month_number(F.col("listed_month")) - (2025 * 12 + 6)).cast("long").alias("rel_month")).agg(F.count("*").alias("n"))


@query(f"WITH {PANEL}, {EDGES} SELECT pan.h3, pan.month, round(avg(q.p), 6) AS nbr FROM pan LEFT JOIN edges ON src = pan.h3 LEFT JOIN pan q ON q.h3 = dst AND q.month = pan.month GROUP BY 1, 2")
def spatial_lag(spark, sf_dir):
    return rounded(panels.neighbour_mean(panel(spark, sf_dir), edges(spark, sf_dir), "price_azn_m2_median", "nbr").select("h3", "month", "nbr"))


@query(f"WITH {PANEL}, {EDGES} SELECT pan.h3, pan.month, round(avg(q.p), 6) AS nbr FROM pan LEFT JOIN edges ON src = pan.h3 LEFT JOIN pan q ON q.h3 = dst AND q.t = pan.t - 1 GROUP BY 1, 2")
def nbr_target_encoding(spark, sf_dir):
    return rounded(panels.target_encoding(panel(spark, sf_dir), edges(spark, sf_dir), "price_azn_m2_median", "nbr").select("h3", "month", "nbr"))


@query(f"""WITH {PANEL}, span AS (SELECT unnest(generate_series(min(t), max(t))) AS t FROM pan), cl AS (SELECT h3, median(ln(p)) AS m FROM pan GROUP BY 1)
SELECT c.h3, printf('%04d-%02d', (s.t - 1) // 12, (s.t - 1) % 12 + 1) AS month, round(coalesce(last_value(ln(p) IGNORE NULLS) OVER (PARTITION BY c.h3 ORDER BY s.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), cl.m), 6) AS log_filled, p IS NOT NULL AS observed
FROM (SELECT DISTINCT h3 FROM pan) c CROSS JOIN span s LEFT JOIN pan ON pan.h3 = c.h3 AND pan.t = s.t JOIN cl ON cl.h3 = c.h3""")
def forward_fill(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(panels.forward_fill_log(panels.complete_panel(p, panels.month_span(p))).select("h3", "month", "log_filled", "observed"))


@query(f"""WITH {PANEL}, k AS (SELECT h3, p, row_number() OVER (PARTITION BY h3 ORDER BY month DESC) AS k, count(*) OVER (PARTITION BY h3) AS n FROM pan),
m AS (SELECT h3, avg(p) FILTER (WHERE k <= 3) AS late, avg(p) FILTER (WHERE k > 3 AND (n < 7 OR k <= 6)) AS early FROM k WHERE n >= 4 GROUP BY 1)
SELECT h3, round((late - early) / early * 100, 6) AS momentum_pct FROM m""")
def recent_momentum(spark, sf_dir):
    return rounded(panels.recent_momentum(panel(spark, sf_dir)))


@query(f"WITH {PANEL} SELECT h3, round(arg_max(p, month), 6) AS last_price, max(month) AS last_month FROM pan GROUP BY 1")
def last_observed(spark, sf_dir):
    return rounded(panels.last_observed(panel(spark, sf_dir)))


@query(f"WITH {PANEL} SELECT h3, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.9), 6) AS p90 FROM pan GROUP BY 1")
def price_band(spark, sf_dir):
    return rounded(panels.price_band(panel(spark, sf_dir)))


@query("""SELECT count(*) - count(DISTINCT h3 || '|' || month) AS repeated, (count(*) FILTER (WHERE price_azn_m2_median IS NULL OR price_azn_m2_median <= 0))::BIGINT AS price,
(count(*) FILTER (WHERE NOT coalesce(regexp_full_match(month, '[0-9]{4}-[0-9]{2}'), false)))::BIGINT AS month FROM panel""")
def panel_violations(spark, sf_dir):
    from kvartal.schema import violations

    return violations(table(spark, sf_dir, "panel"), ["h3", "month"], {"price": F.col("price_azn_m2_median") > 0, "month": F.col("month").rlike(r"^\d{4}-\d{2}$")})


# ---------------------------------------------------------------- features of cells

_NODES = ", ".join(f"round({km('lat', 'lon', y, x)}, 6) AS dist_node_{n}_km" for n, (y, x) in NODES.items())
_NEAREST = "least(" + ", ".join(km("lat", "lon", y, x) for y, x in NODES.values()) + ")"
_ZONES = " OR ".join(f"{km('lat', 'lon', y, x)} <= {r}" for y, x, r in REDEVELOPMENT.values())
_STATIONS = "st AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {y}, {x}, {repr(o) if o else 'NULL'}, {repr(p) if p else 'NULL'})" for n, y, x, o, p in STATIONS) + ") s(name, y, x, opened, planned))"


@query(f"WITH {CENTRES} SELECT h3, round({km('lat', 'lon', 40.3703, 49.8403)}, 6) AS dist_centre_km, {_NODES}, round({_NEAREST}, 6) AS dist_nearest_node_km, round(1 / (1 + {_NEAREST}), 6) AS node_gravity, ({_ZONES})::BIGINT AS in_redev_zone FROM mid")
def masterplan_features(spark, sf_dir):
    return rounded(features.masterplan_features(centres(spark, sf_dir)))


@query(f"""WITH {PANEL}, {CENTRES}, {_STATIONS}, months AS (SELECT DISTINCT month FROM pan),
d AS (SELECT h3, month, {km('mid.lat', 'mid.lon', 'st.y', 'st.x')} AS d FROM mid CROSS JOIN months JOIN st ON coalesce(opened, planned) <= month)
SELECT h3, month, round(min(d), 6) AS dist_metro_km, count(*) FILTER (WHERE d <= 2.0) AS n_stations_2km, round(any_value({km('mid.lat', 'mid.lon', 40.3925, 49.8090)}), 6) AS dist_treatment_km
FROM d JOIN mid USING (h3) GROUP BY 1, 2""")
def metro_features(spark, sf_dir):
    return rounded(features.metro_features(centres(spark, sf_dir), panel(spark, sf_dir).select("month"), include_planned=True))


@query(f"""WITH {PANEL}, {CENTRES}, {EDGES}, {_STATIONS}, ix AS (SELECT DISTINCT month, dense_rank() OVER (ORDER BY month) - 1 AS month_ix FROM pan),
nb AS (SELECT pan.h3, pan.month, avg(q.p) AS v FROM pan JOIN edges ON src = pan.h3 JOIN pan q ON q.h3 = dst AND q.t = pan.t - 1 GROUP BY 1, 2),
d AS (SELECT h3, month, min({km('mid.lat', 'mid.lon', 'st.y', 'st.x')}) AS d, count(*) FILTER (WHERE {km('mid.lat', 'mid.lon', 'st.y', 'st.x')} <= 2.0) AS near FROM mid CROSS JOIN ix JOIN st ON opened <= month GROUP BY 1, 2)
SELECT a.h3, a.month, round(a.p, 6) AS price_azn_m2_median, month_ix, round(l1.p, 6) AS lag_own_1m, round(l3.p, 6) AS lag_own_3m, round((l1.p - l4.p) / l4.p * 100, 6) AS mom_3m, round(nb.v, 6) AS nbr_price_prev_month,
round(l1.new_share, 6) AS new_share_prev_month, l1.n AS n_listings_prev_month, round({km('lat', 'lon', 40.3703, 49.8403)}, 6) AS dist_centre_km, {_NODES}, round({_NEAREST}, 6) AS dist_nearest_node_km, round(1 / (1 + {_NEAREST}), 6) AS node_gravity, ({_ZONES})::BIGINT AS in_redev_zone,
round(d.d, 6) AS dist_metro_km, round({km('lat', 'lon', 40.3925, 49.8090)}, 6) AS dist_treatment_km, near AS n_stations_2km
FROM pan a JOIN pan l1 ON l1.h3 = a.h3 AND l1.t = a.t - 1 LEFT JOIN pan l3 ON l3.h3 = a.h3 AND l3.t = a.t - 3 LEFT JOIN pan l4 ON l4.h3 = a.h3 AND l4.t = a.t - 4
JOIN ix ON ix.month = a.month LEFT JOIN nb ON nb.h3 = a.h3 AND nb.month = a.month LEFT JOIN mid ON mid.h3 = a.h3 LEFT JOIN d ON d.h3 = a.h3 AND d.month = a.month""")
def feature_matrix(spark, sf_dir):
    out = features.feature_matrix(panel(spark, sf_dir), centres(spark, sf_dir), edges(spark, sf_dir))
    return rounded(out.select("h3", "month", "price_azn_m2_median", *features.FEATURES))


_LAND = "land AS (SELECT * FROM (VALUES " + ", ".join(f"({x1}, {y1}, {x2}, {y2})" for (x1, y1), (x2, y2) in zip(LAND, LAND[1:] + LAND[:1]) if y1 != y2) + ") e(x1, y1, x2, y2))"


@query(f"WITH {CENTRES}, {_LAND} SELECT h3 FROM mid JOIN land ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1 HAVING count(*) % 2 = 1")
def land_cells(spark, sf_dir):
    return features.land_cells(centres(spark, sf_dir)).select("h3")


@query()
def cells_geojson(spark, sf_dir):
    """Features of cells with their last price, cut to the land."""
    return features.cells_geojson(table(spark, sf_dir, "cells"), panels.last_observed(panel(spark, sf_dir)))


# ---------------------------------------------------------------- units of analysis and graphs


@query(f"WITH {EDGES} SELECT * FROM edges")
def cell_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"""WITH {EDGES}, two AS (SELECT a.src, b.dst, 2 AS ring FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst)
SELECT src, dst, min(ring)::INT AS ring FROM (SELECT src, dst, 1 AS ring FROM edges UNION ALL SELECT * FROM two) GROUP BY 1, 2""")
def k_ring(spark, sf_dir):
    return graph.k_ring(edges(spark, sf_dir), 2)


_ADJ = "full_a AS (SELECT * FROM edges UNION SELECT h3, h3 FROM cells), deg AS (SELECT src, count(*) AS n FROM full_a GROUP BY 1), adj AS (SELECT f.src, f.dst, 1 / sqrt(a.n * b.n) AS weight FROM full_a f JOIN deg a ON a.src = f.src JOIN deg b ON b.src = f.dst)"


@query(f"WITH {EDGES}, {_ADJ} SELECT src, dst, round(weight, 6) AS weight FROM adj")
def adjacency_normalised(spark, sf_dir):
    return rounded(graph.normalised_adjacency(edges(spark, sf_dir), table(spark, sf_dir, "cells")))


@query(f"WITH {EDGES}, {_ADJ} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM adj WHERE src <> dst")
def neighbour_weights(spark, sf_dir):
    return rounded(graph.neighbour_weights(graph.normalised_adjacency(edges(spark, sf_dir), table(spark, sf_dir, "cells"))))


@query("SELECT h3, 'blk:' || substr(split_part(h3, ':', 2), 1, 3) AS block FROM cells")
def kd_blocks(spark, sf_dir):
    return table(spark, sf_dir, "cells").select("h3", kd_block(F.col("h3")).alias("block"))


@query(f"""WITH p AS (SELECT row_no, lat, lon FROM listings WHERE lat IS NOT NULL AND lon IS NOT NULL),
i AS (SELECT row_no, any_value(p.lat) AS y, any_value(p.lon) AS x, min(h3) AS cell FROM p LEFT JOIN cells c ON p.lat BETWEEN c.lat_min AND c.lat_max AND p.lon BETWEEN c.lon_min AND c.lon_max GROUP BY 1),
{CENTRES}, far AS (SELECT row_no, arg_min(mid.h3, {km('y', 'x', 'mid.lat', 'mid.lon')}) AS cell FROM i CROSS JOIN mid WHERE i.cell IS NULL GROUP BY 1)
SELECT row_no, cell FROM i WHERE cell IS NOT NULL UNION ALL SELECT * FROM far""")
def assign_cells(spark, sf_dir):
    return assign_boxes(table(spark, sf_dir, "listings"), "row_no", "lat", "lon", table(spark, sf_dir, "cells"))


GRID = HexGrid()
_HEX = """xy AS (SELECT *, (lon - 49.85) * (pi() / 180 * 6371.0088 * cos(radians(40.4))) AS x, (lat - 40.4) * (pi() / 180 * 6371.0088) AS y FROM flats WHERE lat IS NOT NULL AND lon IS NOT NULL),
ax AS (SELECT *, (x * (sqrt(3) / 3) - y / 3) / 0.53 AS q, y * (2.0 / 3) / 0.53 AS r FROM xy),
rd AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM ax),
df AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM rd),
hx AS (SELECT *, 'hx:' || (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT || ':' || (CASE WHEN dr > ds AND NOT (dq > dr AND dq > ds) THEN -rq - rs ELSE rr END)::BIGINT AS cell FROM df)"""


def hexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flats(spark, sf_dir).where("lat is not null and lon is not null").withColumn("cell", GRID.cell(F.col("lat"), F.col("lon")))


@query(f"WITH {FLATS}, {_HEX} SELECT row_no, cell FROM hx")
def hex_assign(spark, sf_dir):
    return hexed(spark, sf_dir).select("row_no", "cell")


@query(f"""WITH {FLATS}, {_HEX}, c AS (SELECT cell, count(*) AS n, split_part(cell, ':', 2)::BIGINT AS q, split_part(cell, ':', 3)::BIGINT AS r FROM hx GROUP BY 1)
SELECT cell, n, round(40.4 + r * (1.5 * 0.53 / (pi() / 180 * 6371.0088)), 6) AS lat, round(49.85 + (q + r / 2.0) * (sqrt(3) * 0.53 / (pi() / 180 * 6371.0088 * cos(radians(40.4)))), 6) AS lon FROM c""")
def hex_centroids(spark, sf_dir):
    n = hexed(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"))
    lat, lon = GRID.centroid(F.col("cell"))
    return rounded(n.select("cell", "n", lat.alias("lat"), lon.alias("lon")))


@query(f"""WITH {FLATS}, {_HEX}, c AS (SELECT DISTINCT cell, split_part(cell, ':', 2)::BIGINT AS q, split_part(cell, ':', 3)::BIGINT AS r FROM hx)
SELECT a.cell AS src, b.cell AS dst FROM c a JOIN c b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))""")
def hex_edges(spark, sf_dir):
    cells = hexed(spark, sf_dir).select(F.col("cell").alias("h3")).distinct()
    return graph.restrict(GRID.neighbours(cells), cells)


@query()
def kd_fit(spark, sf_dir):
    """Equal-count boxes fitted on all finite coordinates of the listings, wrong ones included."""
    from kvartal.operators.tessellation import fit_kd

    return fit_kd(flats(spark, sf_dir), "lat", "lon").cells()


@query()
def market_regions(spark, sf_dir):
    """Contiguous price regions of hexagons, fitted on months before 2026."""
    from kvartal.operators.clustering import market_regions as fit

    rows = hexed(spark, sf_dir)
    return fit(rows, GRID.neighbours(rows.select(F.col("cell").alias("h3"))), 120, "2026-01")


@query()
def micro_zones(spark, sf_dir):
    """Contiguous zones of the panel's cells."""
    from kvartal.operators.clustering import micro_zones as fit

    return fit(panel(spark, sf_dir), centres(spark, sf_dir), edges(spark, sf_dir), 12)


# ---------------------------------------------------------------- text fields


@query("""WITH t AS (SELECT row_no, translate(price, chr(160) || chr(8201) || chr(8239) || chr(8199), '    ') AS s FROM listings),
n AS (SELECT row_no, regexp_replace(regexp_replace(regexp_extract(s, '[0-9][0-9\\s.,]*'), '\\s+', '', 'g'), '[.,]+$', '') AS n FROM t)
SELECT row_no, round(CASE WHEN regexp_full_match(n, '[0-9]{1,3}([.,][0-9]{3})+') THEN TRY_CAST(regexp_replace(n, '[.,]', '', 'g') AS DOUBLE) ELSE TRY_CAST(replace(n, ',', '.') AS DOUBLE) END, 6) AS number FROM n""")
def parse_numbers(spark, sf_dir):
    return rounded(table(spark, sf_dir, "listings").select("row_no", first_number(F.col("price")).alias("number")))


@query("SELECT row_no, floor AS a, CASE WHEN floor IS NOT NULL THEN floors END AS b FROM listings WHERE floor IS NOT NULL")
def parse_floors(spark, sf_dir):
    rows = table(spark, sf_dir, "listings").where("floor is not null")
    text = F.when(F.col("floors").isNotNull(), F.concat("floor", F.lit(" / "), "floors", F.lit(" mərtəbə"))).otherwise(F.concat("floor", F.lit(" mərtəbə")))
    return rows.select("row_no", floor_pair(text).alias("f")).select("row_no", F.col("f.floor").alias("a"), F.col("f.floors").alias("b"))


@query("SELECT row_no, listed_month AS month FROM listings WHERE listed_month IS NOT NULL")
def parse_months(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("Yanvar", "Fevral", "Mart", "Aprel", "May", "İyun", "İyul", "Avqust", "Sentyabr", "Oktyabr", "Noyabr", "Dekabr")])
    rows = table(spark, sf_dir, "listings").where("listed_month is not null")
    text = F.concat(F.lit("15 "), F.element_at(names, F.substring("listed_month", 6, 2).cast("int")), F.lit(" "), F.substring("listed_month", 1, 4))
    return rows.select("row_no", listed_month(text, F.to_date(F.lit("2026-08-31"))).alias("month"))


@query("""SELECT 'FEED-' || listing_id AS listing_id, round(lat, 6) AS lat, area AS area_m2, round(price_azn_m2 * area, 6) AS price_azn, coalesce(rooms, 0) AS rooms, CASE WHEN has_repair THEN 'new' ELSE 'old' END AS building_type,
CASE WHEN length(updated_at) >= 7 THEN substr(updated_at, 1, 7) ELSE '2026-08' END AS listed_month, coalesce(location_name, '') AS district
FROM listings WHERE price_azn_m2 * area > 0 AND area > 0 AND lat IS NOT NULL AND lon IS NOT NULL""")
def flatten_nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "listings")
    node = F.struct(
        F.col("listing_id").alias("id"), "path", F.struct(F.col("area").alias("value")).alias("area"), F.struct((F.col("price_azn_m2") * F.col("area")).alias("total"), "currency").alias("price"), "rooms", "floor", "floors",
        F.col("has_repair").alias("hasRepair"), F.struct(F.col("location_name").alias("name"), "lat", "lon").alias("location"), F.transform("photos", lambda p: F.struct(p.alias("large"), F.lit(None).cast("string").alias("thumbnail"))).alias("photos"), F.col("updated_at").alias("updatedAt"),
    )
    flat = flatten_node(rows.select(node.alias("node")))
    out = normalise_nodes(flat, F.to_date(F.lit("2026-08-31")))
    return out.select("listing_id", F.round("lat", 6).alias("lat"), "area_m2", F.round("price_azn", 6).alias("price_azn"), "rooms", "building_type", "listed_month", "district")


# ---------------------------------------------------------------- repeated adverts

_ONE = "one AS (SELECT DISTINCT ON (listing_id) * FROM flats ORDER BY listing_id, row_no)"
_CAND = f"""cand AS (SELECT least(a.listing_id, b.listing_id) AS a, greatest(a.listing_id, b.listing_id) AS b, a.image_phash AS pa, b.image_phash AS pb FROM one a JOIN one b
ON a.rooms = b.rooms AND a.floor = b.floor AND a.building_floors = b.building_floors AND a.listing_id < b.listing_id AND abs(a.lat - b.lat) < 0.004
AND abs(a.price_azn_m2 - b.price_azn_m2) <= 0.1 * greatest(a.price_azn_m2, b.price_azn_m2) AND abs(a.area_m2 - b.area_m2) <= 0.05 * greatest(a.area_m2, b.area_m2)
WHERE {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1000 <= 300)"""
_HAM = "CASE WHEN regexp_full_match(pa, '[0-9a-fA-F]{1,16}') AND regexp_full_match(pb, '[0-9a-fA-F]{1,16}') THEN bit_count(xor(('0x' || pa)::UBIGINT, ('0x' || pb)::UBIGINT)) ELSE 64 END"


def first_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each listing."""
    rows = flats(spark, sf_dir)
    return rows.groupBy("listing_id").agg(*[F.min_by(c, "row_no").alias(c) for c in rows.columns if c != "listing_id"])


@query(f"WITH {FLATS}, {_ONE}, {_CAND} SELECT a, b FROM cand")
def dedup_candidates(spark, sf_dir):
    return resolve.candidate_pairs(first_versions(spark, sf_dir))


@query(f"WITH {FLATS}, {_ONE}, {_CAND} SELECT a, b, ({_HAM})::BIGINT AS bits FROM cand")
def phash_distances(spark, sf_dir):
    rows = first_versions(spark, sf_dir)
    ids = rows.select("listing_id", "image_phash")
    pairs = resolve.candidate_pairs(rows).join(ids.select(F.col("listing_id").alias("a"), F.col("image_phash").alias("pa")), "a").join(ids.select(F.col("listing_id").alias("b"), F.col("image_phash").alias("pb")), "b")
    return pairs.select("a", "b", phash_hamming(F.col("pa"), F.col("pb")).alias("bits"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each listing with its documents' texts, in order of doc_id, as description."""
    docs = table(spark, sf_dir, "documents").where("listing_id is not null and text is not null")
    texts = docs.groupBy("listing_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda d: d["text"]), "\n").alias("description"))
    return first_versions(spark, sf_dir).join(texts, "listing_id", "left")


@query(f"""WITH RECURSIVE {FLATS}, {_ONE}, {_CAND}, e AS (SELECT a, b FROM cand WHERE {_HAM} <= 6), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, a AS other FROM s UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.other),
m AS (SELECT r.id, arg_min(o.listing_id, (o.listed_month, o.listing_id)) AS canonical FROM r JOIN one o ON o.listing_id = r.other GROUP BY 1)
SELECT id AS listing_id, canonical FROM m WHERE id <> canonical""")
def duplicate_map(spark, sf_dir):
    """What repeats what by image hash or text; the SQL links by image hash alone, which gives the same rows on the small test tables."""
    rows = stored(described(spark, sf_dir), "described")
    return resolve.duplicate_map(rows, stored(resolve.duplicate_pairs(rows), "pairs"))


@query("""WITH d AS (SELECT doc_id, listing_id, coalesce(text, '') AS text FROM documents), pr AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.listing_id = b.listing_id AND a.doc_id < b.doc_id),
ids AS (SELECT a AS id FROM pr UNION SELECT b FROM pr), w AS (SELECT id, unnest(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[\\s\\p{Z}\\x{85}\\x{0B}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS x FROM ids JOIN d ON doc_id = id),
p AS (SELECT id, ' ' || x || ' ' AS x FROM w), g AS (
SELECT id, x AS g FROM p WHERE length(x) <= 3
UNION ALL SELECT id, substr(x, i, 3) FROM (SELECT id, x, unnest(range(1, length(x) - 1)) AS i FROM p WHERE length(x) > 3)
UNION ALL SELECT id, substr(x, i, 4) FROM (SELECT id, x, unnest(range(1, length(x) - 2)) AS i FROM p WHERE length(x) > 3)
UNION ALL SELECT id, substr(x, i, 5) FROM (SELECT id, x, unnest(range(1, length(x) - 3)) AS i FROM p WHERE length(x) > 4)),
tf AS (SELECT id, g, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT g, count(*) AS df FROM tf GROUP BY 1),
wt AS (SELECT id, tf.g, tf * (ln((1 + (SELECT count(*) FROM ids)) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.g = df.g), nm AS (SELECT id, sqrt(sum(w * w)) AS n FROM wt GROUP BY 1),
dot AS (SELECT pr.a, pr.b, sum(x.w * y.w) AS s FROM pr JOIN wt x ON x.id = pr.a JOIN wt y ON y.id = pr.b AND y.g = x.g GROUP BY 1, 2)
SELECT pr.a, pr.b, round(coalesce(s / (na.n * nb.n), 0), 6) AS text_sim FROM pr LEFT JOIN dot ON dot.a = pr.a AND dot.b = pr.b LEFT JOIN nm na ON na.id = pr.a LEFT JOIN nm nb ON nb.id = pr.b""")
def text_similarity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("listing_id is not null")
    a, b = docs.select("listing_id", F.col("doc_id").alias("a")), docs.select("listing_id", F.col("doc_id").alias("b"))
    pairs = a.join(b, "listing_id").where("a < b").select("a", "b")
    return rounded(resolve.text_similarity(pairs, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")))


# ---------------------------------------------------------------- validation, intervals, trends


@query(f"""WITH {PANEL}, x AS (SELECT a.month, a.p AS y, b.p AS yhat FROM pan a JOIN pan b ON a.h3 = b.h3 AND b.t = a.t - 1)
SELECT month, round(avg(abs(y - yhat)), 6) AS mae, round(avg(abs((y - yhat) / y)) * 100, 6) AS mape, round(CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) END, 6) AS r2, count(*) AS n FROM x GROUP BY ROLLUP (month)""")
def naive_metrics(spark, sf_dir):
    p = panels.calendar_lag(panel(spark, sf_dir), {"price_azn_m2_median": "yhat"}, 1)
    return rounded(validation.pooled_and_split(p.where("yhat is not null"), "price_azn_m2_median", "yhat", "month"))


@query(f"""WITH {PANEL}, m AS (SELECT month, row_number() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT month FROM pan))
SELECT (b.k - 19)::INT AS split, a.month, CASE WHEN a.k < b.k THEN 'train' ELSE 'test' END AS role FROM m a JOIN m b ON b.k > 18 AND a.k <= b.k""")
def walk_forward(spark, sf_dir):
    months = [r["month"] for r in panel(spark, sf_dir).select("month").distinct().collect()]  # the calendar's months
    return validation.split_table(spark, validation.walk_forward_splits(months))


@query("""WITH RECURSIVE b AS (SELECT block, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block) AS k FROM (SELECT h3, 'blk:' || substr(split_part(h3, ':', 2), 1, 3) AS block FROM cells) GROUP BY 1),
g AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS sizes, ''::VARCHAR AS block, 0::BIGINT AS fold
  UNION ALL SELECT b.k, list_transform(range(1, 6), lambda i: g.sizes[i] + CASE WHEN i = list_position(g.sizes, list_min(g.sizes)) THEN b.n ELSE 0 END), b.block, list_position(g.sizes, list_min(g.sizes))::BIGINT - 1 FROM g JOIN b ON b.k = g.k + 1)
SELECT h3, fold::INT AS fold FROM cells JOIN g ON g.block = 'blk:' || substr(split_part(h3, ':', 2), 1, 3)""")
def block_folds(spark, sf_dir):
    """Folds of whole blocks, balanced greedily."""
    return validation.block_folds(table(spark, sf_dir, "cells"), kd_block(F.col("h3")))


def _naive_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.calendar_lag(panel(spark, sf_dir), {"price_azn_m2_median": "yhat"}, 1).where("yhat is not null")
    return p.select("h3", "month", F.col("price_azn_m2_median").alias("y"), "yhat", (F.col("yhat") * 0.9).alias("lo"), (F.col("yhat") * 1.1).alias("hi"))


_BAND = f"{PANEL}, x AS (SELECT a.month, a.p AS y, b.p AS yhat, b.p * 0.9 AS lo, b.p * 1.1 AS hi FROM pan a JOIN pan b ON a.h3 = b.h3 AND b.t = a.t - 1)"
_SCORES = "s AS (SELECT greatest(lo - y, y - hi) AS s, row_number() OVER (ORDER BY greatest(lo - y, y - hi)) AS k, count(*) OVER () AS n FROM x WHERE month < '2026-06')"


@query(f"WITH {_BAND}, {_SCORES} SELECT round(s, 6) AS \"offset\", n FROM s WHERE k = least(ceil(round((n + 1) * 0.8, 9)), n)")
def conformal_offset(spark, sf_dir):
    return rounded(intervals.conformal_offset(_naive_band(spark, sf_dir).where("month < '2026-06'"), "y", "lo", "hi"))


@query(f"WITH {_BAND}, {_SCORES}, o AS (SELECT s FROM s WHERE k = least(ceil(round((n + 1) * 0.8, 9)), n)) SELECT round(avg(CASE WHEN y BETWEEN least(lo - o.s, yhat) AND greatest(hi + o.s, yhat) THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n FROM x CROSS JOIN o WHERE month >= '2026-06'")
def interval_coverage(spark, sf_dir):
    band = _naive_band(spark, sf_dir)
    o = intervals.conformal_offset(band.where("month < '2026-06'"), "y", "lo", "hi").select("offset")
    held = band.where("month >= '2026-06'").crossJoin(F.broadcast(o))  # one row
    return rounded(intervals.coverage(held.select("y", *intervals.widen(F.col("lo"), F.col("yhat"), F.col("hi"), F.col("offset"))), "y", "q10", "q90"))


@query(f"WITH {_BAND} SELECT round(quantile_cont(abs(y - yhat), 0.8), 6) AS half_width, count(*) AS n FROM x")
def residual_band(spark, sf_dir):
    return rounded(intervals.residual_band(_naive_band(spark, sf_dir), "y", "yhat"))


_SLOPES = f"{PANEL}, ix AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS k, count(*) OVER () AS total FROM (SELECT DISTINCT month FROM pan)), sl AS (SELECT h3, regr_slope(ln(p), -k) AS slope, count(*) AS n FROM pan JOIN ix USING (month) WHERE k <= least(22, total - 1) GROUP BY 1 HAVING count(*) >= 8)"


@query(f"WITH {_SLOPES} SELECT h3, round(slope, 9) AS slope, n FROM sl")
def cell_trend_slopes(spark, sf_dir):
    return rounded(scenario.trend_slopes(panel(spark, sf_dir)), 9)


_GRAVITY = f"{_SLOPES}, {CENTRES}, gr AS (SELECT h3, 1 / (1 + {_NEAREST}) AS g FROM mid), gs AS (SELECT greatest(0.0, (sum(n) * sum(n * g * slope) - sum(n * g) * sum(n * slope)) / (sum(n) * sum(n * g * g) - sum(n * g) * sum(n * g))) AS gravity_slope FROM sl JOIN gr USING (h3))"


@query(f"WITH {_GRAVITY} SELECT round(gravity_slope, 9) AS gravity_slope FROM gs")
def gravity_slope(spark, sf_dir):
    return rounded(scenario.gravity_slope(panel(spark, sf_dir), features.masterplan_features(centres(spark, sf_dir))), 9)


# ---------------------------------------------------------------- difference in differences

_DID = f"did AS (SELECT *, {km('lat', 'lon', 40.3925, 49.8090)} AS d, substr(listed_month, 1, 4)::BIGINT * 12 + substr(listed_month, 6, 2)::BIGINT - (2025 * 12 + 6) AS rel FROM flats WHERE lat IS NOT NULL AND lon IS NOT NULL)"


def _did(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal.did_frame(hexed(spark, sf_dir), radius_km=3.0, buffer_km=4.0, control_max_km=15.0)


@query(f"WITH {FLATS}, {_DID} SELECT row_no, round(d, 6) AS dist_treatment_km, d <= 3.0 AS treated, rel AS rel_month, rel >= 0 AS post, round(ln(price_azn_m2), 6) AS log_price FROM did WHERE d <= 3.0 OR (d > 4.0 AND d <= 15.0)")
def did_frame(spark, sf_dir):
    return rounded(_did(spark, sf_dir).select("row_no", "dist_treatment_km", "treated", "rel_month", "post", "log_price"))


@query(f"WITH {FLATS}, {_DID} SELECT d <= 3.0 AS treated, rel AS rel_month, count(*) AS n FROM did WHERE d <= 3.0 OR (d > 4.0 AND d <= 15.0) GROUP BY 1, 2")
def did_counts(spark, sf_dir):
    return _did(spark, sf_dir).groupBy("treated", "rel_month").agg(F.count("*").alias("n"))


@query()
def did_att(spark, sf_dir):
    """Effect of the opening on listings nearby."""
    return causal.spatial_did(_did(spark, sf_dir))


@query()
def event_study(spark, sf_dir):
    """Effect by months around the opening."""
    frame = _did(spark, sf_dir)
    return causal.event_study(frame)


# ---------------------------------------------------------------- predictions and serving


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, mid = panel(spark, sf_dir), centres(spark, sf_dir)
    base = panels.last_observed(p)
    ahead = base.select("h3", F.explode(F.array(F.lit(12), F.lit(24))).alias("horizon_months"), "last_price").select("h3", "horizon_months", (F.col("last_price") * F.exp(0.004 * F.col("horizon_months"))).alias("y_pred"))
    band = panels.price_band(p).join(base, "h3")
    widths = band.select("h3", ((F.col("last_price") - F.col("p10")) / F.col("last_price")).alias("rel_lo"), ((F.col("p90") - F.col("last_price")) / F.col("last_price")).alias("rel_hi"))
    mp = features.masterplan_features(mid)
    return scenario.predictions(ahead, mid, mp, widths, base, scenario.gravity_slope(p, mp), 0.05, "2026-08")


_NY, _NX = scenario.next_station()
_PHI = "(0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * t"
_PRED = f"""{_GRAVITY}, lo AS (SELECT h3, arg_max(p, month) AS base FROM pan GROUP BY 1), bd AS (SELECT h3, greatest(0.01, (base - quantile_cont(p, 0.1)) / base) AS rl, greatest(0.01, (quantile_cont(p, 0.9) - base) / base) AS rh FROM pan JOIN lo USING (h3) GROUP BY h3, base),
sc AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {a}, {str(b).lower()})" for k, (a, b) in SCENARIOS.items())}) s(scenario, pull, transit)),
f AS (SELECT lo.h3, h, scenario, base, base * exp(0.004 * h) * exp((pull - 1) * gravity_slope * h * coalesce(g, 0) + CASE WHEN transit AND {km('mid.lat', 'mid.lon', _NY, _NX)} <= 1.0 THEN 0.05 * greatest(0.0, least(1.0, (h - 6) / 3.0)) ELSE 0 END) AS q50, rl, rh
 FROM lo CROSS JOIN (SELECT unnest([12, 24]) AS h) CROSS JOIN sc CROSS JOIN gs JOIN mid USING (h3) LEFT JOIN gr USING (h3) JOIN bd USING (h3)),
b AS (SELECT *, q50 * greatest(0.05, 1 - rl * pow(h, 0.2)) AS q10, q50 * (1 + rh * pow(h, 0.2)) AS q90, (q50 / base - 1) * 100 AS app FROM f),
z AS (SELECT *, (median(app) OVER (PARTITION BY scenario, h) - app) / greatest((q90 - q10) / base * 100 / (2 * 1.2815515655446004), 1e-6) AS z FROM b),
tt AS (SELECT *, 1 / (1 + 0.3275911 * (abs(z) / sqrt(2))) AS t FROM z),
pred AS (SELECT h3, '2026-08' AS base_month, h::BIGINT AS horizon_months, scenario, q10, q50, q90, app AS appreciation_pct, 1 - CASE WHEN z >= 0 THEN (1 + (1 - {_PHI} * exp(-z * z / 2))) / 2 ELSE (1 - (1 - {_PHI} * exp(-z * z / 2))) / 2 END AS hotspot_prob FROM tt)"""


@query(f"WITH {_PRED} SELECT h3, base_month, horizon_months, scenario, round(q10, 4) AS q10, round(q50, 4) AS q50, round(q90, 4) AS q90, round(appreciation_pct, 4) AS appreciation_pct, round(hotspot_prob, 4) AS hotspot_prob FROM pred")
def predictions(spark, sf_dir):
    return rounded(_predictions(spark, sf_dir), 4)


@query(f"WITH {_PRED} SELECT h3, round(q90 - q10, 4) AS value FROM pred WHERE scenario = 'baseline' AND horizon_months = 12")
def map_layer(spark, sf_dir):
    return rounded(serving.layer_values(_predictions(spark, sf_dir), panel(spark, sf_dir), "baseline", 12, "uncertainty").select("h3", "value"), 4)


@query(f"WITH {PANEL}, {CENTRES}, v AS (SELECT arg_max(p, month) AS v FROM pan JOIN mid USING (h3) GROUP BY h3) SELECT round(quantile_cont(v, 0.05), 4) AS vmin, round(quantile_cont(v, 0.95), 4) AS vmax FROM v")
def colour_bounds(spark, sf_dir):
    layer = serving.layer_values(_predictions(spark, sf_dir), panel(spark, sf_dir), "baseline", 12, "current_price")
    return rounded(serving.colour_bounds(layer, "current_price"), 4)


@query(f"WITH {PANEL}, v AS (SELECT h3, arg_max(p, month) AS value, sum(n) AS w FROM pan GROUP BY 1) SELECT 'blk:' || substr(split_part(h3, ':', 2), 1, 3) AS zone, round(sum(value * w) / sum(w), 6) AS value FROM v GROUP BY 1")
def zone_means(spark, sf_dir):
    p = panel(spark, sf_dir)
    values = panels.last_observed(p).select("h3", F.col("last_price").alias("value"))
    return rounded(serving.zone_layer(values, values.select("h3", kd_block(F.col("h3")).alias("zone")), p))


@query(f"WITH {PANEL} SELECT h3, count(*) AS months, round(sum(p), 4) AS total FROM pan GROUP BY 1")
def cell_bundles(spark, sf_dir):
    b = serving.cell_bundle(panel(spark, sf_dir), _predictions(spark, sf_dir)).where("history is not null")
    total = F.aggregate("history", F.lit(0.0), lambda a, x: a + x["price_azn_m2_median"])
    return b.select("h3", F.size("history").cast("long").alias("months"), F.round(total, 4).alias("total"))


_FOUND = "f AS (SELECT * FROM flats WHERE rooms = 3 AND building_type = 'new' AND coalesce(price_azn, 0) >= 50000 AND coalesce(price_azn, 0) <= 400000 AND coalesce(area_m2, 0) >= 40)"


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search(flats(spark, sf_dir), rooms=3, building_type="new", price_min=50000, price_max=400000, area_min=40)


@query(f"WITH {FLATS}, {_FOUND} SELECT row_no FROM f")
def listing_search(spark, sf_dir):
    return _search(spark, sf_dir).select("row_no")


@query(f"WITH {FLATS}, {_FOUND} SELECT row_no, 2 AS page, (SELECT count(*) FROM f)::INT AS total, ceil((SELECT count(*) FROM f) / 20.0)::INT AS total_pages FROM f ORDER BY coalesce(price_azn, 0) DESC, row_no LIMIT 20 OFFSET 20")
def listing_page(spark, sf_dir):
    return serving.page(_search(spark, sf_dir), "price_desc", 2, 20, key="row_no").select("row_no", "page", "total", "total_pages")


_SORTED = {"price_asc": "coalesce(price_azn, 0)", "price_desc": "coalesce(price_azn, 0) DESC", "price_m2_asc": "price_azn_m2", "price_m2_desc": "price_azn_m2 DESC", "area_desc": "coalesce(area_m2, 0) DESC", "newest": "listed_month DESC"}


@query(f"WITH {FLATS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, row_no FROM flats ORDER BY {order}, row_no LIMIT 20)" for name, order in _SORTED.items()))
def listing_sorts(spark, sf_dir):
    """The first page in every order that listings alone have."""
    rows, out = flats(spark, sf_dir), None
    for name in _SORTED:
        one = serving.page(rows, name, 1, 20, key="row_no").select(F.lit(name).alias("sort"), "row_no")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {FLATS} SELECT row_no, price_azn_m2 FROM flats WHERE listing_id = (SELECT min(listing_id) FROM flats)")
def listing_by_id(spark, sf_dir):
    rows = flats(spark, sf_dir)
    return serving.by_id(rows, rows.agg(F.min("listing_id")).first()[0]).select("row_no", "price_azn_m2")


@query(f"WITH {PANEL} SELECT month, round(p, 6) AS price, n AS n_listings FROM pan WHERE h3 = (SELECT min(h3) FROM pan)")
def cell_history(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(serving.cell_history(p, p.agg(F.min("h3")).first()[0]).select("month", F.col("price_azn_m2_median").alias("price"), "n_listings"))


@query(f"WITH {_PRED} SELECT scenario, horizon_months, round(q10, 4) AS q10, round(q50, 4) AS q50, round(q90, 4) AS q90 FROM pred WHERE h3 = (SELECT min(h3) FROM pred)")
def cell_forecast(spark, sf_dir):
    found = stored(_predictions(spark, sf_dir), "predictions")
    return rounded(serving.cell_forecast(found, found.agg(F.min("h3")).first()[0]).select("scenario", "horizon_months", "q10", "q50", "q90"), 4)


@query(f"""WITH {_PRED}, one AS (SELECT * FROM pred WHERE scenario = 'transit' AND horizon_months = 24), cur AS (SELECT h3, arg_max(p, month) AS v FROM pan GROUP BY 1)
SELECT 'appreciation_pct' AS metric, h3, round(appreciation_pct, 4) AS value FROM one UNION ALL SELECT 'q50', h3, round(q50, 4) FROM one UNION ALL SELECT 'hotspot_prob', h3, round(hotspot_prob, 4) FROM one
UNION ALL SELECT 'uncertainty', h3, round(q90 - q10, 4) FROM one UNION ALL SELECT 'current_price', h3, round(v, 4) FROM one JOIN cur USING (h3)""")
def map_layers(spark, sf_dir):
    """The layer of every metric of the map."""
    found, p, out = stored(_predictions(spark, sf_dir), "predictions"), panel(spark, sf_dir), None
    for name in serving.METRICS:
        one = serving.layer_values(found, p, "transit", 24, name).select(F.lit(name).alias("metric"), "h3", "value")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


@query(f"WITH {FLATS} SELECT list_sort(list(DISTINCT district) FILTER (WHERE district <> '')) AS districts, round(min(price_azn), 4) AS price_azn_min, round(max(price_azn), 4) AS price_azn_max, min(area_m2) AS area_m2_min, max(area_m2) AS area_m2_max FROM flats")
def facets(spark, sf_dir):
    return rounded(serving.facets(flats(spark, sf_dir)), 4)


_RANKS = f"""{_PRED}, fc AS (SELECT mid.h3, {km('lat', 'lon', 40.4, 49.85)} AS dm, 1 / (1 + {_NEAREST}) AS g FROM mid), fr AS (SELECT *, (rank() OVER (ORDER BY dm) - 1) * 100.0 / count(*) OVER () AS mr, (rank() OVER (ORDER BY g) - 1) * 100.0 / count(*) OVER () AS gk FROM fc),
k AS (SELECT h3, p, row_number() OVER (PARTITION BY h3 ORDER BY month DESC) AS k, count(*) OVER (PARTITION BY h3) AS n FROM pan), mo AS (SELECT h3, avg(p) FILTER (WHERE k <= 3) AS late, avg(p) FILTER (WHERE k > 3 AND (n < 7 OR k <= 6)) AS early FROM k WHERE n >= 4 GROUP BY 1),
mr AS (SELECT h3, (rank() OVER (ORDER BY (late - early) / early) - 1) * 100.0 / count(*) OVER () AS mom FROM mo), ap AS (SELECT h3, q50 AS q12, (rank() OVER (ORDER BY appreciation_pct) - 1) * 100.0 / count(*) OVER () AS ar FROM pred WHERE scenario = 'polycentric' AND horizon_months = 12),
pb AS (SELECT h3, quantile_cont(p, 0.1) AS a, quantile_cont(p, 0.9) AS z, arg_max(p, month) AS last FROM pan GROUP BY 1)"""


@query(f"""WITH {_RANKS} SELECT row_no, CASE WHEN a IS NULL THEN 'unknown' WHEN price_azn_m2 < a THEN 'underpriced' WHEN price_azn_m2 > z THEN 'overpriced' WHEN price_azn_m2 < last THEN 'below average' ELSE 'above average' END AS price_position,
round(CASE WHEN a IS NOT NULL AND a <> z THEN greatest(0.0, least(100.0, (price_azn_m2 - a) / (z - a) * 100)) ELSE 50 END, 3) AS price_percentile
FROM flats LEFT JOIN pb USING (h3)""")
def price_positions(spark, sf_dir):
    from kvartal.functions.numeric import price_percentile, price_position

    p = panel(spark, sf_dir)
    band = panels.price_band(p).join(panels.last_observed(p), "h3")
    rows = flats(spark, sf_dir).join(band, "h3", "left")
    return rows.select("row_no", price_position(F.col("price_azn_m2"), F.col("p10"), F.col("p90"), F.col("last_price")).alias("price_position"), F.round(price_percentile(F.col("price_azn_m2"), F.col("p10"), F.col("p90")), 3).alias("price_percentile"))


_ENRICH = f"""{_PRED}, {_STATIONS},
ft AS (SELECT mid.h3, min({km('mid.lat', 'mid.lon', 'st.y', 'st.x')}) AS dm FROM mid CROSS JOIN st WHERE opened <= '2026-08' GROUP BY 1),
fc AS (SELECT h3, (rank() OVER (ORDER BY dm) - 1) * 100.0 / count(*) OVER () AS metro, (rank() OVER (ORDER BY g) - 1) * 100.0 / count(*) OVER () AS grav FROM ft JOIN gr USING (h3)),
kk AS (SELECT h3, p, row_number() OVER (PARTITION BY h3 ORDER BY month DESC) AS k, count(*) OVER (PARTITION BY h3) AS n FROM pan),
m0 AS (SELECT h3, avg(p) FILTER (WHERE k <= 3) AS late, avg(p) FILTER (WHERE k > 3 AND (n < 7 OR k <= 6)) AS early FROM kk WHERE n >= 4 GROUP BY 1),
mo AS (SELECT h3, (late - early) / early * 100 AS mom, (rank() OVER (ORDER BY (late - early) / early * 100) - 1) * 100.0 / count(*) OVER () AS mr FROM m0),
ap AS (SELECT h3, q50 AS q12, (rank() OVER (ORDER BY appreciation_pct) - 1) * 100.0 / count(*) OVER () AS ar FROM pred WHERE scenario = 'baseline' AND horizon_months = 12),
pb AS (SELECT h3, quantile_cont(p, 0.1) AS a, quantile_cont(p, 0.9) AS z, arg_max(p, month) AS last FROM pan GROUP BY 1)"""


@query(f"""WITH {_ENRICH} SELECT row_no, CASE WHEN a IS NULL THEN 'unknown' WHEN price_azn_m2 < a THEN 'underpriced' WHEN price_azn_m2 > z THEN 'overpriced' WHEN price_azn_m2 < last THEN 'below average' ELSE 'above average' END AS price_position,
round_even(coalesce(mom, 0), 1) AS momentum_3m_pct,
greatest(0, least(100, round_even(0.30 * coalesce(ar, 0) + 0.25 * CASE WHEN q12 <> 0 AND price_azn_m2 > 0 THEN greatest(0.0, least(100.0, 50 + (q12 - price_azn_m2) / q12 * 200)) ELSE 50 END + 0.20 * (100 - coalesce(metro, 100)) + 0.15 * coalesce(grav, 0) + 0.10 * coalesce(mr, 0), 0)))::INT AS investment_score
FROM flats LEFT JOIN pb USING (h3) LEFT JOIN fc USING (h3) LEFT JOIN mo USING (h3) LEFT JOIN ap USING (h3)""")
def enrich_listings(spark, sf_dir):
    """Listings with their cell's figures and an investment score."""
    mid = centres(spark, sf_dir)
    metro = features.metro_features(mid, spark.createDataFrame([("2026-08",)], "month string")).drop("month")
    facts = features.masterplan_features(mid).join(metro, "h3")
    rows = flats(spark, sf_dir).withColumnRenamed("h3", "cell")
    out = serving.enrich(rows, panel(spark, sf_dir), facts, _predictions(spark, sf_dir))
    return out.select("row_no", "price_position", "momentum_3m_pct", "investment_score")


@query(f"WITH {PANEL} SELECT round((SELECT avg(v) FROM (SELECT var_samp(ln(price_azn_m2)) AS v FROM flats GROUP BY h3)) / (SELECT var_pop(ln(price_azn_m2)) FROM flats), 6) AS within_var_share")
def within_var_share(spark, sf_dir):
    return rounded(study.within_variance_share(flats(spark, sf_dir)))


@query(f"""WITH {PANEL}, m AS (SELECT h3, count(DISTINCT month) AS m, sum(n) AS n, count(*) AS r FROM pan GROUP BY 1)
SELECT count(*) AS n_cells, sum(r)::BIGINT AS panel_rows, round(sum(n) / (SELECT count(*) FROM flats) * 100, 6) AS retained_pct, median(m) AS median_months, round(avg(CASE WHEN m >= 12 THEN 1.0 ELSE 0.0 END) * 100, 6) AS cells_ge_12_months_pct FROM m""")
def unit_summary(spark, sf_dir):
    return rounded(study.unit_summary(flats(spark, sf_dir), panel(spark, sf_dir)))


@query(f"""WITH {FLATS}, {CENTRES}, gr AS (SELECT h3, 1 / (1 + {_NEAREST}) AS g FROM mid), c AS (SELECT h3, median(price_azn_m2) AS q FROM flats GROUP BY 1)
SELECT h3, h::BIGINT AS horizon_months, round(q * 0.9 * (1 + a / 100 * 0.5), 4) AS q10, round(q * (1 + a / 100), 4) AS q50, round(q * 1.1 * (1 + a / 100 * 1.5) * sqrt(h / 12), 4) AS q90, round(a, 6) AS appreciation_pct
FROM (SELECT *, g * 5 * CASE WHEN h = 24 THEN 1.8 ELSE 1 END AS a FROM c JOIN gr USING (h3) CROSS JOIN (SELECT unnest([12, 24]) AS h))""")
def snapshot_projection(spark, sf_dir):
    q = exact_group_median(flats(spark, sf_dir), ["h3"], "price_azn_m2").withColumnRenamed("median", "q50")
    cells = q.join(features.masterplan_features(centres(spark, sf_dir)).select("h3", "node_gravity"), "h3").select("h3", "node_gravity", (F.col("q50") * 0.9).alias("q10"), "q50", (F.col("q50") * 1.1).alias("q90"))
    out = scenario.snapshot_projection(cells, "2026-08")
    return out.select("h3", "horizon_months", *[F.round(c, 4).alias(c) for c in ("q10", "q50", "q90")], F.round("appreciation_pct", 6).alias("appreciation_pct"))


@query("""SELECT place_id, round(CASE WHEN z >= 0 THEN (1 + e) / 2 ELSE (1 - e) / 2 END, 6) AS cdf FROM (SELECT place_id, z, 1 - """ + _PHI + """ * exp(-z * z / 2) AS e FROM (SELECT place_id, z, 1 / (1 + 0.3275911 * (abs(z) / sqrt(2))) AS t FROM (SELECT place_id, (radius_m - 300) / 100 AS z FROM places)))""")
def normal_scores(spark, sf_dir):
    return rounded(table(spark, sf_dir, "places").select("place_id", normal_cdf((F.col("radius_m") - 300) / 100).alias("cdf")))


# ---------------------------------------------------------------- facts, outlines, single listings


@query(f"WITH {_STATIONS} SELECT name, y::DOUBLE AS lat, x::DOUBLE AS lon, opened, planned FROM st")
def stations(spark, sf_dir):
    return serving.stations(spark)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {y}::DOUBLE, {x}::DOUBLE)" for n, (y, x) in NODES.items()) + ") n(name, lat, lon)")
def polycentric_nodes(spark, sf_dir):
    return serving.nodes(spark)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.cells_geojson(table(spark, sf_dir, "cells"), clip=False)


@query("SELECT 'blk:' || substr(split_part(h3, ':', 2), 1, 3) AS block, round(sum((lat_max - lat_min) * (lon_max - lon_min)), 6) AS area, count(*) AS n_cells FROM cells GROUP BY 1")
def block_outlines(spark, sf_dir):
    """Area of each block's dissolved outline, holes taken off, in square degrees."""
    from kvartal.operators.outlines import dissolved

    shapes = dissolved(_boxes(spark, sf_dir).withColumn("block", kd_block(F.col("h3"))), "block")
    shape = F.from_json("feature", "geometry struct<type: string, coordinates: string>, properties struct<n_cells: long>")
    one, many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).otherwise(F.flatten(many))
    half = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, i: s + (F.get(F.get(r, i - 1), F.lit(0)) * F.get(F.get(r, i), F.lit(1)) - F.get(F.get(r, i), F.lit(0)) * F.get(F.get(r, i - 1), F.lit(1))) / 2)
    rows = shapes.select("block", shape.alias("f")).select("block", "f.properties.n_cells", F.explode(rings).alias("ring"))
    return rows.groupBy("block").agg(F.round(F.sum(half(F.col("ring"))), 6).alias("area"), F.first("n_cells").alias("n_cells"))


@query(f"""WITH p AS (SELECT row_no, lat, lon FROM listings WHERE lat IS NOT NULL AND lon IS NOT NULL),
d AS (SELECT row_no, h3, round(sqrt(pow(greatest(0, lon_min - lon, lon - lon_max), 2) + pow(greatest(0, lat_min - lat, lat - lat_max), 2)), 9) AS d FROM p CROSS JOIN cells)
SELECT row_no, round(min(d), 6) AS away FROM d GROUP BY 1""")
def nearest_cells(spark, sf_dir):
    """How far, in degrees, each listing is from the cell polygon nearest to it."""
    from kvartal.operators.outlines import nearest_polygon

    rows = table(spark, sf_dir, "listings")
    found = nearest_polygon(rows, "row_no", "lat", "lon", _boxes(spark, sf_dir))
    gap = lambda v, low, high: F.greatest(F.lit(0.0), F.col(low) - F.col(v), F.col(v) - F.col(high))
    sides = found.join(table(spark, sf_dir, "cells").select("h3", "lat_min", "lat_max", "lon_min", "lon_max"), "h3").join(rows.select("row_no", "lat", "lon"), "row_no")
    x, y = gap("lon", "lon_min", "lon_max"), gap("lat", "lat_min", "lat_max")
    return sides.select("row_no", F.round(F.round(F.sqrt(x * x + y * y), 9), 6).alias("away"))


@query(f"WITH {FLATS}, {EDGES}, m AS (SELECT h3, median(price_azn_m2) AS m FROM flats GROUP BY 1) SELECT src AS h3, round(avg(m), 6) AS nbr_price FROM edges JOIN m ON m.h3 = dst GROUP BY 1")
def neighbour_price(spark, sf_dir):
    from kvartal.operators.cross_section import neighbour_price as around

    return rounded(around(flats(spark, sf_dir), edges(spark, sf_dir)))


@query()
def listing_model_folds(spark, sf_dir):
    """Errors of a model of single listings, as plain means over spatial folds."""
    from kvartal.operators import cross_section

    rows = cross_section.listing_features(flats(spark, sf_dir), centres(spark, sf_dir), edges(spark, sf_dir), "2026-08")
    folds = validation.block_folds(table(spark, sf_dir, "cells"), kd_block(F.col("h3")))
    return cross_section.mean_of_folds(cross_section.evaluate_listings(stored(rows, "listing-features"), folds))


# ---------------------------------------------------------------- models


@query()
def ridge_forecast(spark, sf_dir):
    """Prices of all cells rolled forward by the spatial-lag ridge."""
    from kvartal.operators.forecast import ridge_forecast as roll

    p = panel(spark, sf_dir)
    filled = panels.forward_fill_log(panels.complete_panel(p, panels.month_span(p)))
    return roll(filled, graph.neighbour_weights(graph.normalised_adjacency(edges(spark, sf_dir), p)))


@query()
def tree_predictions(spark, sf_dir):
    """Boosted trees walked forward over every month after the 18th, against the naive prediction."""
    from kvartal.operators.models import evaluate_walk_forward

    fm = stored(features.feature_matrix(panel(spark, sf_dir), centres(spark, sf_dir), edges(spark, sf_dir)), "features")
    months = [r["month"] for r in fm.select("month").distinct().collect()]  # the calendar's months
    return evaluate_walk_forward(fm, features.FEATURES, "price_azn_m2_median", validation.walk_forward_splits(months))
