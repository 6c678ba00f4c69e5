"""Models of single listings at one snapshot: features, evaluation by blocks, prices by cell with a band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.operators import features, models
from kvartal.operators.intervals import residual_band
from kvartal.operators.quantiles import exact_group_median
from kvartal.operators.validation import metric_columns

LEAST_TEST, LEAST_TRAIN = 10, 50
EVALUATION_TREES = {"maxIter": 200, "stepSize": 0.1}
FINAL_TREES = {"maxIter": 300, "stepSize": 0.1}
OWN = ["area_m2", "rooms", "floor", "building_floors", "is_new"]
OF_CELLS = [*features.MASTERPLAN, "dist_metro_km", "n_stations_2km", "nbr_price"]
FEATURES = [*OWN, *OF_CELLS]


def neighbour_price(listings: DataFrame, edges: DataFrame, cell: str = "h3", price: str = "price_azn_m2") -> DataFrame:
    """(h3, nbr_price): mean over the adjacent cells of their median price, all at one snapshot; cells without a priced neighbour are absent."""
    medians = exact_group_median(listings, [cell], price).select(F.col(cell).alias("dst"), "median")
    return edges.join(medians, "dst").groupBy(F.col("src").alias("h3")).agg(F.avg("median").alias("nbr_price"))


def listing_features(listings: DataFrame, centres: DataFrame, edges: DataFrame, month: str) -> DataFrame:
    """Listings with FEATURES: their own, those of their cell as of ``month``, and the price around it."""
    one = listings.sparkSession.createDataFrame([(month,)], "month string")
    cells = features.masterplan_features(centres).join(features.metro_features(centres, one).select("h3", "dist_metro_km", "n_stations_2km"), "h3")
    rows = listings.withColumn("is_new", F.when(F.col("building_type") == "new", 1).otherwise(0))
    return rows.join(cells, "h3", "left").join(neighbour_price(listings, edges), "h3", "left")


def mean_of_folds(predictions: DataFrame) -> DataFrame:
    """One row: mae, mape and r2 as plain means over folds, whatever their sizes, and their number."""
    folds = predictions.groupBy("split").agg(*metric_columns("actual", "prediction"))
    return folds.agg(F.avg("mae").alias("mae"), F.avg("mape").alias("mape"), F.avg(F.coalesce("r2", F.lit(0.0))).alias("r2"), F.count("*").alias("n_folds"))


def evaluate_listings(rows: DataFrame, folds: DataFrame, target: str = "price_azn_m2", seed: int = 0, **trees) -> DataFrame:
    """Predictions (split, actual, prediction) of each fold of cells by a model of the others; folds too small to tell anything are left out."""
    return models.evaluate_folds(rows, FEATURES, target, folds, naive=None, seed=seed, least_test=LEAST_TEST, least_train=LEAST_TRAIN, shared=OF_CELLS, **{**EVALUATION_TREES, **trees})


def cell_prices(rows: DataFrame, target: str = "price_azn_m2", share: float = 0.8, seed: int = 0, **trees) -> DataFrame:
    """(h3, q10, q50, q90, actual): medians by cell of the model's prices, with a band of residuals; q10 is at least 0."""
    model = models.model_of(rows, FEATURES, target, seed, **{**FINAL_TREES, **trees}).fit(rows)
    known = model.predict(rows.where(F.col(target).isNotNull()))
    band = residual_band(known, target, "prediction", share).select("half_width")
    q50, actual = exact_group_median(known, ["h3"], "prediction").withColumnRenamed("median", "q50"), exact_group_median(known, ["h3"], target).withColumnRenamed("median", "actual")
    wide = q50.join(actual, "h3").crossJoin(F.broadcast(band))  # one row
    return wide.select("h3", F.greatest(F.lit(0.0), F.col("q50") - F.col("half_width")).alias("q10"), "q50", (F.col("q50") + F.col("half_width")).alias("q90"), "actual")


def seeded_sample(df: DataFrame, rows: int, key: str, seed: int = 0) -> DataFrame:
    """``rows`` rows without replacement, the same for a seed: those with the least hash of their key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in an order fixed by a seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
