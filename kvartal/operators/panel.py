"""The (cell, month) panel and operators along its months and over its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from kvartal.functions.moments import month_number, month_text
from kvartal.operators.quantiles import exact_group_median


def build_panel(listings: DataFrame, cell: str = "h3", month: str = "listed_month", price: str = "price_azn_m2", min_listings: int = 3) -> DataFrame:
    """Median, mean, number and share of new buildings by cell and month; thinner cell-months are dropped."""
    new = F.when(F.col("building_type") == "new", 1.0).otherwise(0.0)
    rows = listings.select(F.col(cell).alias("h3"), F.col(month).alias("month"), F.col(price).alias("_price"), new.alias("_new"))
    stats = rows.groupBy("h3", "month").agg(F.avg("_price").alias("price_azn_m2_mean"), F.count("*").alias("n_listings"), F.avg("_new").alias("new_share")).where(F.col("n_listings") >= min_listings)
    # A cell may hold a tenth of all rows: its median is found by bins, not from all its values in one buffer.
    medians = exact_group_median(rows, ["h3", "month"], "_price").select(F.col("h3").alias("_h3"), F.col("month").alias("_month"), F.col("median").alias("price_azn_m2_median"))
    same = F.col("h3").eqNullSafe(F.col("_h3")) & F.col("month").eqNullSafe(F.col("_month"))
    return stats.join(medians, same, "left").select("h3", "month", "price_azn_m2_median", "price_azn_m2_mean", "n_listings", "new_share")


def month_span(panel: DataFrame) -> DataFrame:
    """All calendar months from the panel's first to its last."""
    ends = panel.agg(F.min(month_number(F.col("month"))).alias("a"), F.max(month_number(F.col("month"))).alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("month_no")).select(month_text(F.col("month_no")).alias("month"))


def complete_panel(panel: DataFrame, months: DataFrame) -> DataFrame:
    """One row for each cell and each of ``months``; cell-months not observed have no prices and 0 listings."""
    cells = panel.select("h3").distinct()
    grid = cells.crossJoin(F.broadcast(months.select("month").distinct()))  # the calendar's months
    return grid.join(panel, ["h3", "month"], "left").withColumn("n_listings", F.coalesce("n_listings", F.lit(0).cast("long")))


def month_index(panel: DataFrame) -> DataFrame:
    """(month, month_ix): place of each observed month among the panel's months, from 0."""
    months = panel.select("month").distinct()  # as many as the calendar has
    return months.select("month", (F.dense_rank().over(w.Window.orderBy("month")) - 1).cast("long").alias("month_ix"))


def calendar_lag(panel: DataFrame, columns: dict[str, str], months: int) -> DataFrame:
    """``panel`` with values of the same cell ``months`` calendar months before; NULL where that month was not observed."""
    back = panel.select(F.col("h3"), month_text(month_number(F.col("month")) + months).alias("month"), *[F.col(c).alias(n) for c, n in columns.items()])
    return panel.join(back, ["h3", "month"], "left")


def momentum(price_1: Column, price_4: Column) -> Column:
    """Change in per cent from four months ago to last month."""
    return (price_1 - price_4) / price_4 * 100


def neighbour_mean(panel: DataFrame, edges: DataFrame, column: str, name: str, months_back: int = 0) -> DataFrame:
    """``panel`` with the mean of ``column`` over the neighbours of the cell, itself excluded.

    ``edges``: (src, dst), both ways.  With ``months_back`` the neighbours'
    values of so many calendar months before are taken, which lets nothing of
    the month itself through.
    """
    seen = panel.select(F.col("h3").alias("dst"), month_text(month_number(F.col("month")) + months_back).alias("month"), F.col(column).alias("_v"))
    mean = edges.where("src <> dst").select("src", "dst").distinct().join(seen, "dst").groupBy(F.col("src").alias("h3"), "month").agg(F.avg("_v").alias(name))
    return panel.join(mean, ["h3", "month"], "left")


def target_encoding(panel: DataFrame, edges: DataFrame, column: str, name: str, months_lag: int = 1) -> DataFrame:
    """Neighbours' mean of an earlier month; a lag below one would leak the target."""
    if months_lag < 1:
        raise ValueError("months_lag must be at least 1")
    return neighbour_mean(panel, edges, column, name, months_lag)


def forward_fill_log(dense: DataFrame, price: str = "price_azn_m2_median") -> DataFrame:
    """(h3, month, log_obs, log_filled, observed): log prices carried forward; leading gaps take the cell's median, empty cells that of all."""
    log = F.ln(price)
    cells = dense.groupBy("h3").agg(F.median(log).alias("_cell"))
    every = dense.agg(F.median(log).alias("_all"))
    carried = F.last(log, ignorenulls=True).over(w.Window.partitionBy("h3").orderBy("month").rowsBetween(w.Window.unboundedPreceding, 0))
    return dense.withColumn("_c", carried).join(cells, "h3").crossJoin(F.broadcast(every)).select(  # one row
        "h3", "month", log.alias("log_obs"), F.coalesce("_c", "_cell", "_all").alias("log_filled"), log.isNotNull().alias("observed")
    )


def recent_momentum(panel: DataFrame, price: str = "price_azn_m2_median") -> DataFrame:
    """(h3, momentum_pct): mean of the last three observed months against the three before; of all before where fewer than seven were observed."""
    seen = panel.where(F.col(price).isNotNull())
    by = w.Window.partitionBy("h3")
    k = F.row_number().over(by.orderBy(F.desc("month")))
    rows = seen.select("h3", F.col(price).alias("p"), k.alias("k"), F.count("*").over(by).alias("n"))
    early = F.avg(F.when((F.col("k") > 3) & ((F.col("n") < 7) | (F.col("k") <= 6)), F.col("p")))
    means = rows.groupBy("h3").agg(F.max("n").alias("n"), F.avg(F.when(F.col("k") <= 3, F.col("p"))).alias("late"), early.alias("early")).where("n >= 4")
    return means.select("h3", F.when(F.col("early") > 0, (F.col("late") - F.col("early")) / F.col("early") * 100).otherwise(0.0).alias("momentum_pct"))


def last_observed(panel: DataFrame, price: str = "price_azn_m2_median") -> DataFrame:
    """(h3, last_price, last_month) of the latest month with a price."""
    seen = panel.where(F.col(price).isNotNull())
    return seen.groupBy("h3").agg(F.max_by(price, "month").alias("last_price"), F.max("month").alias("last_month"))


def price_band(panel: DataFrame, price: str = "price_azn_m2_median") -> DataFrame:
    """(h3, p10, p90) of the monthly medians, interpolated."""
    return panel.groupBy("h3").agg(F.percentile(price, F.array(F.lit(0.1), F.lit(0.9))).alias("p")).select("h3", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p90"))
