"""Synthetic listings with planted effects, from hashes of row numbers: the same rows on any number of partitions."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.constants import CITY_CENTRE, NODES, REDEVELOPMENT, STATIONS, TREATMENT, TREATMENT_RADIUS_KM
from kvartal.functions.moments import month_number, month_text
from kvartal.functions.numeric import clip
from kvartal.operators.features import distance_to, in_circles, nearest_of
from kvartal.operators.scenario import opening_ramp


@dataclass(frozen=True)
class Truth:
    """Planted effects in log points, and sizes."""

    seed: int = 7
    per_month: int = 800
    start: str = "2023-01"
    end: str = "2026-08"
    centre_price: float = 3500.0
    edge_price: float = 1300.0
    decay_per_km: float = 0.065
    metro_premium: float = 0.06
    metro_radius_km: float = 0.8
    opening_effect: float = 0.08
    trend: float = 0.004
    node_trend: float = 0.006
    new_premium: float = 0.25
    zone_discount: float = -0.05
    noise: float = 0.18
    duplicate_share: float = 0.06


def uniform(key: Column, seed: int, stream: int) -> Column:
    """A number in (0, 1) fixed by key, seed and stream."""
    return (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(stream)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def gauss(key: Column, seed: int, stream: int) -> Column:
    """A standard normal number fixed by key, seed and stream."""
    return F.sqrt(-2 * F.ln(uniform(key, seed, 2 * stream))) * F.cos(2 * F.pi() * uniform(key, seed, 2 * stream + 1))


def generate_listings(spark: SparkSession, truth: Truth = Truth()) -> tuple[DataFrame, DataFrame]:
    """(listings, map of re-posts to originals) under the listings contract, with the planted effects of ``truth``."""
    a, b = (int(m[:4]) * 12 + int(m[5:]) for m in (truth.start, truth.end))
    months = b - a + 1
    key, s = F.col("id"), truth.seed
    places = [(*CITY_CENTRE, 0.045, 6.0), (*CITY_CENTRE, 0.015, 3.0), *[(y, x, 0.02, 1.0) for y, x in NODES.values()]]
    total, at, lat, lon, spread = sum(p[3] for p in places), 0.0, F.lit(0.0), F.lit(0.0), F.lit(0.0)
    pick = uniform(key, s, 1)
    for y, x, sd, weight in places:
        here = (pick >= at / total) & (pick < (at + weight) / total)
        lat, lon, spread = F.when(here, y).otherwise(lat), F.when(here, x).otherwise(lon), F.when(here, sd).otherwise(spread)
        at += weight
    rows = spark.range(truth.per_month * months).select("id", lat.alias("y0"), lon.alias("x0"), spread.alias("sd"))
    rows = rows.withColumn("lat", F.round(F.col("y0") + gauss(key, s, 1) * F.col("sd"), 6)).withColumn("lon", F.round(F.col("x0") + gauss(key, s, 2) * F.col("sd"), 6))
    rows = rows.withColumn("k", (key % months).cast("int")).withColumn("listed_month", month_text(F.lit(a) + F.col("k")))
    rows = rows.withColumn("rooms", (1 + F.floor(uniform(key, s, 11) * 5)).cast("long")).withColumn("area_m2", F.round(clip((30 + 22 * F.col("rooms")) * F.exp(0.35 * gauss(key, s, 3)), 25, 400), 1))
    rows = rows.withColumn("building_floors", F.element_at(F.array(*[F.lit(n) for n in (5, 9, 12, 16, 17, 20)]), (1 + F.floor(uniform(key, s, 12) * 6)).cast("int")).cast("long"))
    rows = rows.withColumn("floor", (1 + F.floor(uniform(key, s, 13) * F.col("building_floors"))).cast("long")).withColumn("centre", distance_to(F.col("lat"), F.col("lon"), CITY_CENTRE))
    rows = rows.withColumn("building_type", F.when(uniform(key, s, 14) < clip(0.9 - 0.01 * F.col("centre"), 0.6, 0.95), "new").otherwise("old"))
    treated = next((y, x) for n, y, x, *_ in STATIONS if n == TREATMENT)
    planned = next(p for n, *_rest, p in STATIONS if n == TREATMENT)
    rel = month_number(F.col("listed_month")) - month_number(F.lit(planned))
    near = distance_to(F.col("lat"), F.col("lon"), treated) <= TREATMENT_RADIUS_KM
    metro = nearest_of(F.col("lat"), F.col("lon"), [(y, x) for _n, y, x, opened, _p in STATIONS if opened]) <= truth.metro_radius_km
    gravity = 1 / (1 + nearest_of(F.col("lat"), F.col("lon"), list(NODES.values())))
    log = (
        F.greatest(F.log(F.lit(truth.centre_price)) - truth.decay_per_km * F.col("centre"), F.log(F.lit(truth.edge_price)))
        + F.when(metro, truth.metro_premium).otherwise(0.0) + F.when(near, truth.opening_effect * opening_ramp(rel)).otherwise(0.0) + truth.trend * F.col("k")
        + truth.node_trend * gravity * F.greatest(F.lit(0), F.col("k") - months // 2) + F.when(F.col("building_type") == "new", truth.new_premium).otherwise(0.0)
        + F.when(in_circles(F.col("lat"), F.col("lon"), list(REDEVELOPMENT.values())), truth.zone_discount).otherwise(0.0) + truth.noise * gauss(key, s, 4)
    )
    rows = rows.withColumn("price_azn_m2", F.round(F.exp(log), 1)).withColumn("price_azn", F.round(F.col("price_azn_m2") * F.col("area_m2"), 0))
    rows = rows.withColumn("image_phash", F.lower(F.lpad(F.hex(F.xxhash64(key, F.lit(s), F.lit(50))), 16, "0"))).withColumn("listing_id", F.format_string("GEN-%07d", key))
    text = F.format_string("%d-room flat of %.1f m2 on floor %d of %d", "rooms", "area_m2", "floor", "building_floors")
    base = rows.select(
        "listing_id", F.lit("generated").alias("source"), "lat", "lon", "price_azn", "area_m2", "price_azn_m2", "rooms", "floor", "building_floors", "building_type", "listed_month", F.format_string("%d-room flat", "rooms").alias("title"),
        F.concat(text, F.lit(", no. "), F.hex(F.xxhash64(key, F.lit(51)))).alias("description"), "image_phash", F.lit("[]").alias("photo_urls"), F.lit("").alias("district"), "id",
    )
    again = base.where(uniform(key, s, 15) < truth.duplicate_share).withColumn("original", F.col("listing_id"))
    bit = F.pmod(F.xxhash64(key, F.lit(16)), F.lit(16)).cast("int")
    flipped = F.concat(F.substring("image_phash", 1, 15), F.lower(F.hex(F.conv(F.substring("image_phash", 16, 1), 16, 10).cast("int").bitwiseXOR(F.lit(1)))))
    again = again.withColumn("listing_id", F.format_string("GEN-DUP-%07d", key)).withColumn("image_phash", F.when(bit >= 0, flipped)).withColumn("price_azn_m2", F.round(F.col("price_azn_m2") * (0.98 + 0.04 * uniform(key, s, 17)), 1))
    again = again.withColumn("lat", F.round(F.col("lat") + 0.0002 * gauss(key, s, 9), 6)).withColumn("lon", F.round(F.col("lon") + 0.0002 * gauss(key, s, 10), 6)).withColumn("description", F.concat(F.lit("Urgent! "), F.col("description")))
    return base.drop("id").unionByName(again.select(*[c for c in base.columns if c != "id"])), again.select("listing_id", "original")


def truth_document(truth: Truth, listings: DataFrame, copies: DataFrame) -> dict:
    """What was planted: parameters, months, the treated station, re-posts with their originals, and sizes."""
    planned = next(p for n, *_rest, p in STATIONS if n == TREATMENT)
    repeated = copies.count()
    return {
        "planted": asdict(truth), "panel_start": truth.start, "panel_end": truth.end, "treatment_station": TREATMENT, "treatment_open_month": planned,
        "n_base_listings": listings.count() - repeated, "n_duplicates": repeated,
    }


def save_generated(spark: SparkSession, out_dir: str, truth: Truth = Truth()) -> tuple[str, str]:
    """Write ``listings.parquet``, the map of re-posts as ``duplicate_map.parquet``, and ``truth.json`` with the planted values; the paths of the first and last.

    The map grows with the listings, so it is a table of its own.
    """
    from kvartal.sources.sinks import write_documents, write_tables

    listings, copies = generate_listings(spark, truth)
    write_tables(out_dir, {"listings": listings, "duplicate_map": copies})
    write_documents(spark, out_dir, {"truth": truth_document(truth, spark.read.parquet(f"{out_dir}/listings.parquet"), spark.read.parquet(f"{out_dir}/duplicate_map.parquet"))})
    return f"{out_dir}/listings.parquet", f"{out_dir}/truth.json"
