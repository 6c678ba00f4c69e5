"""Comparison of units of analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_variance_share(listings: DataFrame, cell: str = "h3", price: str = "price_azn_m2") -> DataFrame:
    """One row: mean over cells of the sample variance of log price, over the variance of all."""
    log = F.ln(price)
    cells = listings.groupBy(cell).agg(F.var_samp(log).alias("v")).agg(F.avg("v").alias("within"))
    every = listings.agg(F.var_pop(log).alias("total"))
    return cells.crossJoin(every).select(F.when(F.col("total") > 0, F.col("within") / F.col("total")).alias("within_var_share"))  # one row each


def unit_summary(listings: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: cells, panel rows, share of listings kept, median months, share of cells with a year of months."""
    months = panel.groupBy("h3").agg(F.countDistinct("month").alias("m"), F.sum("n_listings").alias("n"), F.count("*").alias("rows"))
    cells = months.agg(F.count("*").alias("n_cells"), F.sum("rows").cast("long").alias("panel_rows"), F.median("m").alias("median_months"), (F.avg(F.when(F.col("m") >= 12, 1.0).otherwise(0.0)) * 100).alias("cells_ge_12_months_pct"), F.sum("n").alias("kept"))
    total = listings.agg(F.count("*").alias("all"))
    return cells.crossJoin(total).select("n_cells", "panel_rows", (F.col("kept") / F.col("all") * 100).alias("retained_pct"), "median_months", "cells_ge_12_months_pct")  # one row each


def evaluate_unit(name: str, listings: DataFrame, centres: DataFrame, edges: DataFrame, block, min_listings: int = 3, splits: int | None = None, **trees) -> DataFrame:
    """One row for a unit of analysis: summary, variance within, and skill over the naive prediction in time and in space.

    ``listings`` carry the cell as ``h3``; ``centres``: h3, lat, lon; ``block``:
    Column of a cell's coarse block.  ``splits`` limits the walk-forward part to the last so many.
    """
    from kvartal.operators import features, models, panel, validation
    from kvartal.sources.tables import stored

    table = stored(panel.build_panel(listings, min_listings=min_listings), "unit-panel")
    fm = stored(features.feature_matrix(table, centres, edges), "unit-features")
    months = sorted(r["month"] for r in fm.select("month").distinct().collect())  # the calendar's months
    plan = validation.walk_forward_splits(months)
    forward = models.against_naive(models.evaluate_walk_forward(fm, features.FEATURES, "price_azn_m2_median", plan[-splits:] if splits else plan, **trees))
    # A block may be told from the cell's name or from its centre.
    folds = validation.block_folds(table.select("h3").distinct().join(centres.select("h3", "lat", "lon"), "h3"), block)
    space = models.against_naive(models.evaluate_folds(fm, features.FEATURES, "price_azn_m2_median", folds, exclude=["nbr_price_prev_month"], **trees))
    gain = lambda df, n: df.select(validation.skill(F.col("mae"), F.col("naive_mae")).alias(n))
    parts = unit_summary(listings, table).crossJoin(within_variance_share(listings)).crossJoin(gain(forward, "wf_skill")).crossJoin(gain(space, "skill"))  # one row each
    return parts.select(F.lit(name).alias("name"), "*")


def make_unit(kind: str, **settings) -> "Unit":
    """A unit of analysis by kind: ``hex`` (edge_km), ``kdtree`` (target) or ``market`` (regions, cutoff_month)."""
    kinds = {"hex": _hex_unit, "kdtree": _kd_unit, "market": _market_unit}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}; one of {sorted(kinds)}")
    return kinds[kind](**settings)


class Unit:
    """How a unit of analysis divides listings: ``divide(listings)`` gives (listings with h3, centres, edges, block Column)."""

    def __init__(self, divide):
        self.divide = divide


def _hex_parts(listings: DataFrame, grid):
    from kvartal.operators.graph import restrict

    rows = listings.withColumn("h3", grid.cell(F.col("lat"), F.col("lon")))
    cells = rows.select("h3").distinct()
    lat, lon = grid.centroid(F.col("h3"))
    return rows, cells.select("h3", lat.alias("lat"), lon.alias("lon")), restrict(grid.neighbours(cells), cells)


def _hex_unit(edge_km: float = 0.53) -> Unit:
    from kvartal.operators.tessellation import HexGrid

    grid = HexGrid(edge_km=edge_km)
    return Unit(lambda listings: (*_hex_parts(listings, grid), grid.block(F.col("h3"))))


def _kd_unit(target: int = 140) -> Unit:
    from kvartal.operators import graph, tessellation

    def divide(listings: DataFrame):
        cells = tessellation.fit_kd(listings, "lat", "lon", target).cells()
        placed = tessellation.assign_boxes(listings, "listing_id", "lat", "lon", cells).withColumnRenamed("cell", "h3")
        rows = listings.drop("h3").join(placed, "listing_id")
        return rows, cells.select("h3", "lat", "lon"), graph.box_edges(cells), tessellation.kd_block(F.col("h3"))

    return Unit(divide)


def _market_unit(regions: int = 120, cutoff_month: str | None = None, edge_km: float = 0.53) -> Unit:
    from kvartal.operators import clustering
    from kvartal.operators.tessellation import HexGrid
    from kvartal.sources.tables import stored

    grid = HexGrid(edge_km=edge_km)

    def divide(listings: DataFrame):
        rows, centres, edges = _hex_parts(listings, grid)
        rows = rows.withColumnRenamed("h3", "cell")
        members = stored(clustering.market_regions(rows, edges, regions, cutoff_month), "regions")
        middles = centres.withColumnRenamed("h3", "cell")
        placed = clustering.assign_regions(rows, members, middles).withColumnRenamed("region", "h3")
        means = members.join(middles, "cell").groupBy(F.col("region").alias("h3")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        return placed, stored(means, "region-centres"), stored(clustering.region_edges(edges, members), "region-edges"), grid.block(grid.cell(F.col("lat"), F.col("lon")))

    return Unit(divide)


#: The units that the study compares: three sizes of hexagons, three of equal-count boxes, two numbers of market regions.
CANDIDATES = {
    "hex_1400": ("hex", {"edge_km": 1.4}), "hex_530": ("hex", {"edge_km": 0.53}), "hex_200": ("hex", {"edge_km": 0.2}), "kdtree_n70": ("kdtree", {"target": 70}), "kdtree_n140": ("kdtree", {"target": 140}),
    "kdtree_n280": ("kdtree", {"target": 280}), "market_k120": ("market", {"regions": 120}), "market_k240": ("market", {"regions": 240}),
}


def compare_units(listings: DataFrame, cutoff_month: str | None = None, candidates: dict | None = None, splits: int | None = None, **trees) -> DataFrame:
    """One row for each candidate unit of analysis (:func:`evaluate_unit`); market regions see months before ``cutoff_month`` only."""
    from kvartal.sources.tables import stored

    out = None
    for name, (kind, settings) in (candidates or CANDIDATES).items():
        settings = {**settings, "cutoff_month": cutoff_month} if kind == "market" else settings
        rows, centres, edges, block = make_unit(kind, **settings).divide(listings)
        rows, centres = stored(rows, "unit-rows"), stored(centres, "unit-centres")
        one = stored(evaluate_unit(name, rows, centres, edges, block, splits=splits, **trees), "unit")
        out = one if out is None else out.unionByName(one)
    return out


def recommended(study: DataFrame) -> str | None:
    """Name of the viable unit with the best skill in space, None if none is viable."""
    best = viable(study).first()
    return best["name"] if best else None


def viable(study: DataFrame, least_retained: float = 60.0, least_months: float = 12) -> DataFrame:
    """Units with enough data and history, the best skill first."""
    return study.where((F.col("retained_pct") >= least_retained) & (F.col("median_months") >= least_months)).orderBy(F.desc("skill"), "name")


def family_stability(study: DataFrame) -> DataFrame:
    """(family, low, high, spread, sign_flips) of skills over each family's settings; families of one are left out."""
    family = F.regexp_extract("name", "^[a-z]+", 0)
    s = study.groupBy(family.alias("family")).agg(F.min("skill").alias("low"), F.max("skill").alias("high"), (F.countDistinct(F.col("skill") > 0) > 1).alias("sign_flips"), F.count("*").alias("n"))
    return s.where("n >= 2").select("family", "low", "high", (F.col("high") - F.col("low")).alias("spread"), "sign_flips")
