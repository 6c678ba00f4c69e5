"""Text fields of adverts as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.constants import AZ_MONTHS

SPACES = "\u00a0\u2009\u202f\u2007"


def az_lower(text: Column) -> Column:
    """Lower case with the Azerbaijani pair of dotted and dotless i."""
    return F.lower(F.translate(text, "İI", "iı"))


def plain_spaces(text: Column) -> Column:
    """No-break, thin and figure spaces as plain ones."""
    return F.translate(text, SPACES, " " * len(SPACES))


def first_number(text: Column) -> Column:
    """First number of a text: spaces group thousands, as do points and commas before groups of just three digits; else a comma is a decimal point."""
    run = F.regexp_extract(plain_spaces(text), r"\d[\d\s.,]*", 0)
    num = F.regexp_replace(F.regexp_replace(run, r"\s+", ""), r"[.,]+$", "")
    grouped = num.rlike(r"^\d{1,3}(?:[.,]\d{3})+$")
    return F.when(grouped, F.regexp_replace(num, "[.,]", "")).otherwise(F.translate(num, ",", ".")).try_cast("double")


def positive_number(text: Column) -> Column:
    """First number of a text if it is above zero, as prices and areas are."""
    n = first_number(text)
    return F.when(n > 0, n)


def first_integer(text: Column) -> Column:
    """First run of digits, as numbers of rooms are."""
    return F.regexp_extract(text, r"\d+", 0).try_cast("long")


def floor_pair(text: Column) -> Column:
    """Struct (floor, floors) of ``4/9`` or of a single number."""
    both = text.rlike(r"\d+\s*/\s*\d+")
    part = lambda i: F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", i).try_cast("long")
    return F.struct(F.when(both, part(1)).otherwise(first_integer(text)).alias("floor"), F.when(both, part(2)).alias("floors"))


def listed_month(text: Column, today: Column) -> Column:
    """``YYYY-MM`` of a written date: today, yesterday, or a named month with the year of ``today`` unless it names one."""
    low = az_lower(plain_spaces(text))
    tight = F.regexp_replace(low, r"\s+", "")
    found = F.regexp_extract(low, r"\b((?:19|20)\d{2})\b", 1)
    year = F.when(found != "", found).otherwise(F.date_format(today, "yyyy"))
    out = F.lit(None).cast("string")
    for number in range(12, 0, -1):
        out = F.when(low.contains(AZ_MONTHS[number - 1]), F.concat(year, F.lit(f"-{number:02d}"))).otherwise(out)
    out = F.when(tight.contains("dünən"), F.date_format(F.date_sub(today, 1), "yyyy-MM")).otherwise(out)
    return F.when(tight.contains("bugün"), F.date_format(today, "yyyy-MM")).otherwise(out)


def month_prefix(stamp: Column, today: Column) -> Column:
    """Month of an ISO moment, else that of ``today``."""
    return F.when(F.length(stamp) >= 7, F.substring(stamp, 1, 7)).otherwise(F.date_format(today, "yyyy-MM"))


def path_tail(path: Column) -> Column:
    """Last part of a path, ``unknown`` if there is none."""
    tail = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)
    return F.when(F.coalesce(tail, F.lit("")) == "", "unknown").otherwise(tail)


def json_list(text: Column) -> Column:
    """Array of a JSON list of strings; empty for anything else."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def phash_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex; 64 where either is no such hash."""
    ok = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    half = lambda c, at: F.conv(F.substring(F.lpad(c, 16, "0"), at, 8), 16, 10).cast("long")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when(F.coalesce(ok, F.lit(False)), bits).otherwise(64).cast("long")


NODE = (
    "id string, path string, area struct<value: double>, price struct<total: double, currency: string>, rooms long, floor long, floors long, hasRepair boolean, "
    "location struct<name: string, lat: double, lon: double>, photos array<struct<large: string, thumbnail: string>>, updatedAt string"
)


def flatten_node(nodes: DataFrame, column: str = "node") -> DataFrame:
    """Nested advert nodes as flat rows; every level may be missing.  A photo is its large address, else its thumbnail."""
    n = lambda path: F.col(f"{column}.{path}")
    photos = F.filter(F.transform(n("photos"), lambda p: F.coalesce(F.nullif(p["large"], F.lit("")), p["thumbnail"])), lambda x: F.coalesce(x, F.lit("")) != "")
    return nodes.select(
        n("id").alias("listing_id"), n("path").alias("path"), n("price.total").alias("price"), n("price.currency").alias("currency"), n("area.value").alias("area"),
        n("location.lat").alias("lat"), n("location.lon").alias("lon"), n("rooms").alias("rooms"), n("floor").alias("floor"), n("floors").alias("floors"),
        n("hasRepair").alias("has_repair"), n("location.name").alias("location_name"), n("updatedAt").alias("updated_at"), F.coalesce(photos, F.array().cast("array<string>")).alias("photos"),
    )


def normalise_nodes(flat: DataFrame, today: Column, source: str = "feed", prefix: str = "FEED-") -> DataFrame:
    """Flat nodes as rows of the listings contract; rows without a positive price and area and both coordinates are dropped."""
    good = (F.col("price") > 0) & (F.col("area") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    number = F.coalesce(F.nullif(F.col("listing_id"), F.lit("")), path_tail(F.col("path")), F.lit("unknown"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return flat.where(good).select(
        F.concat(F.lit(prefix), number).alias("listing_id"), F.lit(source).alias("source"), "lat", "lon", F.col("price").cast("double").alias("price_azn"), F.col("area").cast("double").alias("area_m2"),
        F.bround(F.col("price") / F.col("area"), 1).alias("price_azn_m2"), zero("rooms").alias("rooms"), zero("floor").alias("floor"), zero("floors").alias("building_floors"),
        F.when(F.col("has_repair"), "new").otherwise("old").alias("building_type"), month_prefix(F.col("updated_at"), today).alias("listed_month"), F.lit("").alias("title"), F.lit("").alias("description"),
        F.lit("").alias("image_phash"), F.to_json(F.coalesce("photos", F.array().cast("array<string>"))).alias("photo_urls"), F.coalesce("location_name", F.lit("")).alias("district"),
    )
