"""Queries p1, p2 and p5 over the whole listings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.operators.spatial_join import circle_shapes, polygon_shapes, within_reach
from kvartal.operators.spikes import implausible_readings
from kvartal.operators.units import prices_in_manat
from kvartal.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every advert row with the places that reach it and the regions that contain it."""
    shapes = circle_shapes(table(spark, sf_dir, "places"), "place_id", "lat", "lon", "radius_m").unionByName(
        polygon_shapes(table(spark, sf_dir, "regions"), "region_id", "ring_no", "vertex_no", "lat", "lon")
    )
    return within_reach(table(spark, sf_dir, "listings"), "row_no", "lat", "lon", shapes, unique_ids=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows priced in another currency, scale or basis, with their total in whole manat."""
    prices = prices_in_manat(table(spark, sf_dir, "listings"), table(spark, sf_dir, "fx_rates"))
    return prices.where("other_unit").select("row_no", F.floor(F.round("price_manat", 6) + 0.5).cast("long").alias("price_azn"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices per square metre and areas that can't be true, or that a feed keeps repeating."""
    return implausible_readings(table(spark, sf_dir, "listings"), {"price_azn_m2": 2.0, "area": 4.0})


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found}

# The printed units for an engine without look-behind, and the scale by distance from the level, which is what the chain decides at these sizes.
_METRE = r"(m²|м²|m2|м2|kv\.?\s*m|кв\.?\s*м)\.?"
_UNITS = [
    ("AZM", r"azm|köhnə manat|старых манат"), ("USD", r"\$|usd|dollar|долл"), ("EUR", r"€|eur|avro|евро"), ("TRY", r"₺|lir[əae]|лир|(^|[^\p{L}])(try|tl)($|[^\p{L}])"),
    ("GBP", r"£|gbp|funt|фунт"), ("RUB", r"₽|rub|руб"), ("AZN", r"₼|azn|manat|манат|qəp|гяп|(^|[^\p{L}])man($|[^\p{L}])"),
]


def _unit(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{c}'" for c, p in _UNITS) + " END"


#: Common table expressions up to ``d``: what each row's price comes to in manat as written, and whether its scale shows only in its size.
PRICES = f"""t AS (
  SELECT row_no, h3, listed_month, CASE WHEN area > 0 THEN area END AS area, lower(currency) AS c,
         regexp_replace(lower(translate(coalesce(price, ''), chr(160) || chr(8239) || chr(8201) || chr(8199) || chr(304), '    i')), '\\s+', ' ', 'g') AS p FROM listings),
u AS (SELECT *, regexp_matches(p, '[^0-9., ]') AS words, regexp_matches(p, '{_METRE}') AS per FROM t),
v AS (SELECT *, CASE WHEN per THEN regexp_replace(regexp_replace(p, '^\\s*1 ?{_METRE}', ' '), '{_METRE}', ' ', 'g') ELSE p END AS rest FROM u),
w AS (SELECT *, regexp_replace(regexp_extract(rest, '[0-9][0-9., ]*'), '[., ]+$', '') AS n, words AND regexp_matches(rest, '(^|[^\\p{{L}}])(mln|млн|milyon|million|m)($|[^\\p{{L}}])') AS mil,
      words AND regexp_matches(rest, '(^|[^\\p{{L}}])(min|bin|тыс|k|к)($|[^\\p{{L}}])') AS th, words AND regexp_matches(rest, 'qəp|гяп') AS hu FROM v),
a AS (SELECT *, coalesce(CASE WHEN words THEN {_unit("rest")} END, {_unit("c")}, 'AZN') AS code, CASE WHEN mil THEN 1e6 WHEN th THEN 1e3 WHEN hu THEN 0.01 ELSE 1.0 END AS scale, mil OR th OR hu OR per AS said,
  CASE WHEN regexp_full_match(n, '[0-9]+') THEN n::DOUBLE
       WHEN (mil OR th OR starts_with(n, '0')) AND regexp_full_match(n, '[0-9]+[.,][0-9]+') THEN replace(n, ',', '.')::DOUBLE
       WHEN regexp_full_match(n, '[0-9]{{1,3}}([., ][0-9]{{3}})+') THEN regexp_replace(n, '[., ]', '', 'g')::DOUBLE
       WHEN regexp_full_match(n, '([0-9]+|[0-9]{{1,3}}([., ][0-9]{{3}})+)[.,][0-9]{{1,2}}')
       THEN (regexp_replace(regexp_replace(n, '[.,][0-9]{{1,2}}$', ''), '[., ]', '', 'g') || '.' || regexp_extract(n, '[.,]([0-9]{{1,2}})$', 1))::DOUBLE END AS amount FROM w),
r AS (SELECT a.*, amount * scale * CASE WHEN code = 'AZN' THEN 1.0 ELSE azn_per_unit END * CASE WHEN per THEN area ELSE 1.0 END AS written
      FROM a LEFT JOIN fx_rates ON currency = code AND rate_month = listed_month WHERE amount > 0),
l AS (SELECT h3, median(log10(written)) AS level, median(area) AS usual FROM r WHERE written > 0 GROUP BY 1),
d AS (SELECT r.*, NOT said AND log10(written) - level - log10(coalesce(greatest(1.0 / 3, least(3.0, area / usual)), 1)) < -1.7 AS short FROM r JOIN l USING (h3) WHERE written > 0)"""

_P2 = f"""WITH {PRICES}
SELECT row_no, floor(round(written * CASE WHEN short THEN 1000 ELSE 1 END, 6) + 0.5)::BIGINT AS price_azn FROM d WHERE code <> 'AZN' OR scale <> 1 OR per OR short
"""

SQL = {
    "p2_found": _P2,
    "p1_found": """
WITH l AS (SELECT row_no, lat, lon FROM listings WHERE lat IS NOT NULL AND lon IS NOT NULL),
near AS (
  SELECT l.row_no, p.place_id AS target_id
  FROM places p JOIN l ON l.lat BETWEEN p.lat - p.radius_m / 111000.0 AND p.lat + p.radius_m / 111000.0
  WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - l.lat) / 2), 2)
        + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2)))) <= p.radius_m),
v AS (
  SELECT region_id, ring_no, lat AS y1, lon AS x1,
         coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2
  FROM regions WINDOW w AS (PARTITION BY region_id, ring_no ORDER BY vertex_no)),
inside AS (
  SELECT l.row_no, v.region_id AS target_id
  FROM l JOIN v ON (v.y1 > l.lat) <> (v.y2 > l.lat)
  WHERE l.lon < (v.x2 - v.x1) * (l.lat - v.y1) / (v.y2 - v.y1) + v.x1
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT DISTINCT * FROM (SELECT * FROM near UNION ALL SELECT * FROM inside)
""",
    "p5_found": """
WITH v AS (
  SELECT row_no, source, h3, 'price_azn_m2' AS field_name, price_azn_m2 AS x, 2.0 AS k FROM listings
  UNION ALL SELECT row_no, source, h3, 'area', area, 4.0 FROM listings),
m AS (SELECT *, median(x) OVER (PARTITION BY field_name, h3) AS med FROM v WHERE x IS NOT NULL),
c AS (SELECT *, CASE WHEN lag(x) OVER w = x THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY field_name, source, h3 ORDER BY row_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY field_name, source, h3 ORDER BY row_no) AS run FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY field_name, source, h3, run) AS len FROM r)
SELECT DISTINCT row_no, field_name FROM n WHERE x <= 0 OR x <= med / k OR x >= med * k OR len >= 6
""",
}
