"""Table schemas and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTINGS = (
    "listing_id string, source string, lat double, lon double, price_azn double, area_m2 double, price_azn_m2 double, rooms long, floor long, building_floors long, "
    "building_type string, listed_month string, title string, description string, image_phash string, photo_urls string, district string"
)
PANEL = "h3 string, month string, price_azn_m2_median double, price_azn_m2_mean double, n_listings long, new_share double"
PREDICTIONS = "h3 string, base_month string, horizon_months long, scenario string, q10 double, q50 double, q90 double, appreciation_pct double, hotspot_prob double"


class SchemaError(ValueError):
    """A table breaks its contract."""


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def _require(df: DataFrame, ddl: str) -> None:
    missing = [c for c in _names(ddl) if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")


def violations(df: DataFrame, keys: list[str], rules: dict) -> DataFrame:
    """One row with the number of rows that break each rule, and of surplus rows per key as ``repeated``."""
    marks = [F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).cast("long").alias(name) for name, ok in rules.items()]
    counts = df.agg(F.count("*").alias("_rows"), *marks)
    distinct = df.select(*keys).distinct().agg(F.count("*").alias("_keys"))
    zero = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in rules]
    return counts.crossJoin(distinct).select((F.col("_rows") - F.col("_keys")).cast("long").alias("repeated"), *zero)  # one row each


def validate_listings(df: DataFrame) -> DataFrame:
    """``df`` if it keeps the listings contract, else :class:`SchemaError`."""
    _require(df, LISTINGS)
    bad = violations(df, ["listing_id"], {"price": F.col("price_azn_m2") > 0, "month": F.col("listed_month").rlike(r"^\d{4}-\d{2}$")}).first().asDict()
    if any(bad.values()):
        raise SchemaError(f"listings: {bad}")
    return df


def validate_panel(df: DataFrame) -> DataFrame:
    """``df`` if it has the panel columns and one row per cell and month."""
    _require(df, PANEL)
    bad = violations(df, ["h3", "month"], {}).first().asDict()
    if any(bad.values()):
        raise SchemaError(f"panel: {bad}")
    return df


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of ``ddl``, cast; those that ``df`` lacks are NULL."""
    parts = [p.split() for p in ddl.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in parts])
