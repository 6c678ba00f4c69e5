"""The whole analysis: listings to artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.constants import HORIZONS
from kvartal.operators import causal, features, forecast, graph, intervals, models, panel as panels, resolve, scenario, validation
from kvartal.operators.clustering import micro_zones
from kvartal.operators.tessellation import HexGrid, assign_boxes, fit_kd
from kvartal.sources.sinks import write_documents, write_tables
from kvartal.sources.tables import stored


def run(listings: DataFrame, out_dir: str, target: int = 140, min_train: int = 18, calibrate: int = 6, hold_out: int = 3, zones: int = 35, splits: int | None = None, **trees) -> dict:
    """Listings of the contract to tables and documents in ``out_dir``; returns the metrics.

    Each stage that later ones share is written to the shared folder once.
    ``splits`` limits the walk-forward evaluation to the last so many splits.
    """
    pairs = stored(resolve.duplicate_pairs(listings), "pairs")
    clean, mapping = resolve.without_duplicates(listings, pairs)
    clean = stored(clean, "clean")
    boxes = fit_kd(clean, "lat", "lon", target).cells()
    boxes = stored(boxes, "boxes")
    placed = clean.join(assign_boxes(clean, "listing_id", "lat", "lon", boxes), "listing_id").withColumnRenamed("cell", "h3")
    land = features.land_cells(boxes.select("h3", "lat", "lon"))
    placed = stored(placed.join(land.select("h3"), "h3", "left_semi"), "placed")
    panel = stored(panels.build_panel(placed), "panel")
    mid, edges = boxes.select("h3", "lat", "lon"), stored(graph.restrict(graph.box_edges(boxes), panel), "edges")
    zone_table = micro_zones(panel, mid, edges, zones)
    fm = stored(features.feature_matrix(panel, mid, edges), "features")
    price, months = "price_azn_m2_median", sorted(r["month"] for r in fm.select("month").distinct().collect())  # the calendar's months
    plan = validation.walk_forward_splits(months, min_train)
    forward = models.against_naive(models.evaluate_walk_forward(fm, features.FEATURES, price, plan[-splits:] if splits else plan, **trees)).first()
    folds = validation.block_folds(mid.join(panel.select("h3").distinct(), "h3"), F.concat(F.lit("blk:"), F.substring(F.substring_index("h3", ":", -1), 1, 3)))
    spatial = models.against_naive(models.evaluate_folds(fm, features.FEATURES, price, folds, exclude=["nbr_price_prev_month"], **trees)).first()
    cut, held = months[-(calibrate + hold_out)], months[-hold_out]
    train, later = [m for m in months if m < cut], [m for m in months if m >= cut]
    model = models.model_of(fm, features.FEATURES, price, **trees).fit(fm.where(F.col("month") < cut))
    bounded, _ = models.quantile_intervals(fm, features.FEATURES, price, train, [m for m in later if m < held], **trees)
    final = stored(bounded.where(F.col("month") >= cut).select("h3", "month", price, "q10", "q50", "q90"), "bounds")
    covered = intervals.coverage(final.where(F.col("month") >= held), price, "q10", "q90").first()
    filled = stored(panels.forward_fill_log(panels.complete_panel(panel, panels.month_span(panel))), "filled")
    ahead = forecast.ridge_forecast(filled, graph.neighbour_weights(graph.normalised_adjacency(edges, panel)), HORIZONS)
    grid = HexGrid()
    did = causal.did_frame(placed.withColumn("cell", grid.cell(F.col("lat"), F.col("lon"))))
    try:
        effect = causal.spatial_did(did).first().asDict()
    except ValueError as missing:
        effect = {"att_log": 0.0, "note": str(missing)}
    base = panels.last_observed(panel)
    mp = features.masterplan_features(mid)
    last = final.where(F.col("month") == months[-1]).select("h3", ((F.col("q50") - F.col("q10")) / F.col("q50")).alias("rel_lo"), ((F.col("q90") - F.col("q50")) / F.col("q50")).alias("rel_hi"))
    ahead_all = scenario.predictions(ahead, mid, mp, last, base, scenario.gravity_slope(panel, mp), max(effect["att_log"], 0.0), months[-1])
    metrics = {
        "n_listings": listings.count(), "n_duplicates": mapping.count(), "n_cells": boxes.count(), "panel_rows": panel.count(), "feature_rows": fm.count(),
        "walk_forward": forward.asDict(), "spatial": spatial.asDict(), "coverage": covered.asDict(), "effect": effect, "importances": dict(model.importances()),
    }
    write_tables(out_dir, {"listings": placed, "panel": panel, "zones": zone_table, "predictions": ahead_all, "cell_features": mid.join(mp, "h3").join(folds, "h3", "left").fillna({"fold": -1})})
    write_documents(listings.sparkSession, out_dir, {"metrics": metrics})
    return metrics
