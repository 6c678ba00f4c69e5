"""A running count of listings by cell and time window over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_cells(stream: DataFrame, time: str = "ts", cell: str = "h3", price: str = "price_azn_m2", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, h3, n_listings, price_mean) per window; rows later than the watermark are dropped, state stays bounded by open windows."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, every), F.col(cell).alias("h3"))
    return rows.agg(F.count("*").alias("n_listings"), F.avg(price).alias("price_mean")).select(F.col("window.start").alias("window_start"), "h3", "n_listings", "price_mean")
