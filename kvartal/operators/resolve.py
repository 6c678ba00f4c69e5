"""Re-posts of one flat: spatial blocking, then image hash or text similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions.geo import EARTH_RADIUS_KM, haversine_km
from kvartal.functions.numeric import finite
from kvartal.functions.parsing import phash_hamming
from kvartal.operators.components import connected_components

M_PER_DEGREE = math.pi / 180 * EARTH_RADIUS_KM * 1000
AREA_TOLERANCE = 0.05
#: Width of a band of area or price, in tolerances.
BAND = 4.0


def close_by(a: Column, b: Column, share: float) -> Column:
    return F.abs(a - b) <= share * F.greatest(a, b)


def _bands(value: Column, share: float) -> tuple[Column, Column]:
    """(bands to look in, own band) of a value: those of values within ``share`` of the larger one are among the former."""
    step = -math.log(1 - share) * (1 + 1e-9)
    log = F.ln(value) / (BAND * step)
    none = F.lit(-(1 << 40)).cast("long")  # zero, negative and missing values meet among themselves only
    looked = F.when(value > 0, F.sequence(F.floor(log - 1 / BAND), F.floor(log + 1 / BAND))).otherwise(F.array(none))
    return looked, F.when(value > 0, F.floor(log)).otherwise(none)


def candidate_pairs(listings: DataFrame, max_dist_m: float = 300.0, price_tolerance: float = 0.10) -> DataFrame:
    """(a, b), a < b: listings of equal rooms, floor and floors, near in area and price, within ``max_dist_m``.

    Listings are put into square cells as wide as the distance; a pair meets in
    the same or an adjacent cell, of which half are looked up.  A degree of
    longitude counts as at the greatest latitude, so no pair is lost.  The key
    also has a band of area and one of price: one side is put into its own
    band, the other into all in which a partner may be, so crowded cells fall
    apart and no pair meets twice.  Rows lacking any of the fields have no pair.
    """
    rows = listings.where(finite(F.col("lat")) & finite(F.col("lon"))).select("listing_id", "lat", "lon", "rooms", "floor", "building_floors", "area_m2", "price_azn_m2")
    top = rows.agg(F.max(F.abs("lat")).alias("top")).first()["top"]
    per_lon = M_PER_DEGREE * math.cos(math.radians(min(top or 0.0, 89.9)))
    rows = rows.withColumn("gx", F.floor(F.col("lon") * per_lon / max_dist_m)).withColumn("gy", F.floor(F.col("lat") * M_PER_DEGREE / max_dist_m))
    (area_looked, area_own), (price_looked, price_own) = _bands(F.col("area_m2"), AREA_TOLERANCE), _bands(F.col("price_azn_m2"), price_tolerance)
    a = rows.withColumn("ba", F.explode(area_looked)).withColumn("bp", F.explode(price_looked))
    rows = rows.withColumn("ba", area_own).withColumn("bp", price_own)
    a = a.select([F.col(c).alias(c + "_a") for c in a.columns])
    half = [(0, 0), (1, 0), (0, 1), (1, 1), (1, -1)]
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in half])
    a = a.withColumn("step", F.explode(steps)).withColumn("hx", F.col("gx_a") + F.col("step.x")).withColumn("hy", F.col("gy_a") + F.col("step.y")).withColumn("own", (F.col("step.x") == 0) & (F.col("step.y") == 0))
    b = rows.select([F.col(c).alias(c + "_b") for c in rows.columns])
    same = (F.col("hx") == F.col("gx_b")) & (F.col("hy") == F.col("gy_b"))
    for c in ("rooms", "floor", "building_floors", "ba", "bp"):
        same = same & (F.col(c + "_a") == F.col(c + "_b"))
    near = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) * 1000 <= max_dist_m
    rest = close_by(F.col("price_azn_m2_a"), F.col("price_azn_m2_b"), price_tolerance) & close_by(F.col("area_m2_a"), F.col("area_m2_b"), AREA_TOLERANCE) & near
    once = ~F.col("own") | (F.col("listing_id_a") < F.col("listing_id_b"))
    return a.join(b, same).where(once & (F.col("listing_id_a") != F.col("listing_id_b")) & rest).select(F.least("listing_id_a", "listing_id_b").alias("a"), F.greatest("listing_id_a", "listing_id_b").alias("b"))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words, each word padded by a space on both sides; a word shorter than n counts once. The dotted capital I counts as i."""
    flat = F.trim(F.regexp_replace(F.lower(F.translate(text, "\u0130", "i")), r"(?U)\s+", " "))
    words = F.transform(F.filter(F.split(flat, " "), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def grams(word: Column, n: int) -> Column:
        size = F.length(word)
        return F.when(size <= n, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(word, i, F.lit(n))))

    # A word no longer than the least n gives one gram in all, a longer one its grams of each length that it reaches.
    def of(word: Column) -> Column:
        parts = [grams(word, low)] + [F.when(F.length(word) > n - 1, grams(word, n)).otherwise(F.array().cast("array<string>")) for n in range(low + 1, high + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(words, of))


def text_similarity(pairs: DataFrame, texts: DataFrame, key: str = "id", text: str = "text", low: int = 3, high: int = 5) -> DataFrame:
    """(a, b, text_sim): cosine of TF-IDF vectors of character n-grams, fitted on the texts that occur in a pair.

    NULL and blank texts are like none.  idf is ln((1 + n) / (1 + df)) + 1.
    """
    ids = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).distinct()
    docs = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(ids, key)
    number = ids.agg(F.count("*").alias("_n"))
    tf = docs.select(key, F.explode(char_grams(F.col("_t"), low, high)).alias("g")).groupBy(key, "g").agg(F.count("*").alias("tf"))
    df = tf.groupBy("g").agg(F.count("*").alias("df")).crossJoin(F.broadcast(number))  # one row
    weights = tf.join(df, "g").select(key, "g", (F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weights.join(norms, key).select(key, "g", (F.col("w") / F.col("norm")).alias("w"))
    left = pairs.join(unit.select(F.col(key).alias("a"), "g", F.col("w").alias("wa")), "a")
    dots = left.join(unit.select(F.col(key).alias("b"), "g", F.col("w").alias("wb")), ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.coalesce("s", F.lit(0.0)).alias("text_sim"))


def duplicate_pairs(listings: DataFrame, most_bits: int = 6, least_text: float = 0.80, max_dist_m: float = 300.0, price_tolerance: float = 0.10) -> DataFrame:
    """(listing_id_a, listing_id_b, phash_hamming, text_sim) of candidates whose image hashes or descriptions agree."""
    pairs = candidate_pairs(listings, max_dist_m, price_tolerance)
    ids = listings.select("listing_id", "image_phash")
    hashed = pairs.join(ids.select(F.col("listing_id").alias("a"), F.col("image_phash").alias("pa")), "a").join(ids.select(F.col("listing_id").alias("b"), F.col("image_phash").alias("pb")), "b")
    hashed = hashed.select("a", "b", phash_hamming(F.col("pa"), F.col("pb")).alias("phash_hamming"))
    texts = listings.select(F.col("listing_id").alias("id"), F.col("description").alias("text"))
    both = hashed.join(text_similarity(pairs, texts), ["a", "b"])
    return both.where((F.col("phash_hamming") <= most_bits) | (F.col("text_sim") >= least_text)).select(F.col("a").alias("listing_id_a"), F.col("b").alias("listing_id_b"), "phash_hamming", "text_sim")


def duplicate_map(listings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(listing_id, canonical) of listings that repeat another; the canonical one of a group is the first by (listed_month, listing_id)."""
    code = lambda c: F.xxhash64(c)
    groups = connected_components(pairs.select(code("listing_id_a").alias("src"), code("listing_id_b").alias("dst")))
    known = listings.select("listing_id", "listed_month", code("listing_id").alias("node")).join(groups, "node")
    first = known.groupBy("component").agg(F.min_by("listing_id", F.struct("listed_month", "listing_id")).alias("canonical"))
    return known.join(first, "component").where(F.col("listing_id") != F.col("canonical")).select("listing_id", "canonical")


def without_duplicates(listings: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings without repeats, and the map of what repeats what."""
    mapping = duplicate_map(listings, pairs)
    return listings.join(mapping.select("listing_id"), "listing_id", "left_anti"), mapping
