"""Point and quantile models, their evaluation in time and space, and attribution.

Tables of units of analysis (cells by months) are small beside the rows they
come from.  Up to ``TASK_ROWS`` rows a model is fitted by one task, and the
splits of an evaluation side by side; beyond, Spark's own boosted trees fit it
over the cluster, split after split.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from kvartal.operators.boosting import TREES, Booster
from kvartal.operators.validation import metrics

__all__ = ["TREES", "PriceModel", "SparkPriceModel", "model_of", "evaluate_walk_forward", "evaluate_folds", "against_naive", "mean_abs_contributions", "permutation_effect", "quantile_intervals"]

#: Rows (of training, over all splits at once) that go to tasks whole.
TASK_ROWS = 1_000_000
#: The same where most features are those of cells: a row takes some 150 bytes of a task.
CELL_TASK_ROWS = 4_000_000
SPLIT_PARTITIONS = 64


def _usable(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles; NaN and infinite become NULL, and a flag tells where a value was missing."""
    out = df
    for c in features:
        v = F.col(c).cast("double")
        out = out.withColumn("x_" + c, F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)).withColumn("m_" + c, F.col("x_" + c).isNull().cast("double"))
    return out


class PriceModel:
    """Gradient boosted trees with missing values as they are, fitted by one task."""

    def __init__(self, features: list[str], target: str, seed: int = 0, quantile: float | None = None, **trees):
        self.features, self.target, self.seed, self.quantile, self.trees = features, target, seed, quantile, trees

    def fit(self, df: DataFrame) -> "PriceModel":
        features, target, seed, quantile, trees = self.features, self.target, self.seed, self.quantile, self.trees
        rows = df.where(F.col(target).isNotNull() & ~F.isnan(target)).select(*[F.col(c).cast("double").alias(c) for c in [*features, target]])

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([target, *features], ignore_index=True)  # an order that doesn't hang on how rows arrive
            return pd.DataFrame({"model": [pickle.dumps(Booster.of(seed, quantile, **trees).fit(pdf[features].to_numpy(), pdf[target].to_numpy()))]})

        found = rows.groupBy(F.lit(1).alias("_one")).applyInPandas(one, "model binary").first()
        if found is None:
            raise ValueError("no rows to fit")
        self.model: Booster = pickle.loads(found["model"])
        if not any(len(e) for e in self.model.edges):
            raise ValueError("no feature has two values")
        self.known = [c for c, e in zip(features, self.model.edges) if len(e)]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        features, model = self.features, self.model

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)))

        return df.select(*df.columns, predicted(*[F.col(c).cast("double") for c in features]).alias("prediction"))

    def importances(self) -> list[tuple[str, float]]:
        """Share of each feature in all splits."""
        used = self.model.feature[self.model.feature >= 0]
        counts = np.bincount(used, minlength=len(self.features)) / max(1, len(used))
        return sorted(zip(self.features, counts.tolist()), key=lambda t: (-t[1], t[0]))


class SparkPriceModel:
    """Spark's gradient boosted trees over imputed features with flags for missing ones, fitted over the cluster."""

    def __init__(self, features: list[str], target: str, seed: int = 0, **trees):
        self.features, self.target, self.seed, self.trees = features, target, seed, {**TREES, **trees}

    def fit(self, df: DataFrame) -> "SparkPriceModel":
        rows = _usable(df.where(F.col(self.target).isNotNull()), self.features)
        counts = rows.agg(*[F.count("x_" + c).alias(c) for c in self.features]).first()
        self.known = [c for c in self.features if counts[c]]
        if not self.known:
            raise ValueError("no feature has a value")
        x = ["x_" + c for c in self.known]
        stages = [Imputer(inputCols=x, outputCols=["i_" + c for c in x], strategy="median"), VectorAssembler(inputCols=["i_" + c for c in x] + ["m_" + c for c in self.known], outputCol="_features")]
        stages.append(GBTRegressor(featuresCol="_features", labelCol=self.target, predictionCol="prediction", seed=self.seed, **self.trees))
        self.model = Pipeline(stages=stages).fit(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        return self.model.transform(_usable(df, self.features)).select(*df.columns, "prediction")

    def importances(self) -> list[tuple[str, float]]:
        """Share of split gains of each feature, its flag included."""
        gains = self.model.stages[-1].featureImportances.toArray()
        k = len(self.known)
        return sorted(((c, float(gains[i] + gains[k + i])) for i, c in enumerate(self.known)), key=lambda t: (-t[1], t[0]))


def model_of(df: DataFrame, features: list[str], target: str, seed: int = 0, **trees):
    """An unfitted model for so many rows."""
    return (PriceModel if df.count() <= TASK_ROWS else SparkPriceModel)(features, target, seed, **trees)


def mean_abs_contributions(model: PriceModel, df: DataFrame, top: int = 15) -> DataFrame:
    """(feature, effect): mean absolute contribution of each feature along the paths of the trees, the largest first; these are no Shapley values."""
    features, booster = model.features, model.model

    def add(batches):
        for pdf in batches:
            yield pd.DataFrame(np.abs(booster.contributions(pdf.to_numpy(dtype=float))), columns=features)

    each = df.select(*[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(add, ", ".join(f"`{c}` double" for c in features))
    means = each.agg(*[F.avg(c).alias(c) for c in features])
    pairs = ", ".join(f"'{c}', `{c}`" for c in features)
    return means.select(F.expr(f"stack({len(features)}, {pairs}) as (feature, effect)")).orderBy(F.desc("effect"), "feature").limit(top)


def permutation_effect(model, df: DataFrame, top: int = 15, seed: int = 7) -> DataFrame:
    """(feature, effect): mean absolute change of the prediction when a feature takes the value of another row.

    Rows are paired by hash order within shares, so no sort of the whole table
    goes through one task.
    """
    base = model.predict(df.withColumn("_id", F.monotonically_increasing_id()))
    by = w.Window.partitionBy(F.pmod("_id", F.lit(64))).orderBy(F.xxhash64("_id", F.lit(seed)))
    out = None
    for c in model.known:
        moved = base.withColumnRenamed("prediction", "_p").withColumn(c, F.coalesce(F.lead(c).over(by), F.first(c).over(by)))
        effect = model.predict(moved).agg(F.avg(F.abs(F.col("prediction") - F.col("_p"))).alias("effect")).select(F.lit(c).alias("feature"), "effect")
        out = effect if out is None else out.unionByName(effect)
    return out.orderBy(F.desc("effect"), "feature").limit(top)


def _apart(spark: SparkSession, splits: list[int]) -> Column:
    """A key for each value of ``split``, such that hash partitioning gives each a partition of its own, as far as there are any."""
    rounds = -(-len(splits) // SPLIT_PARTITIONS)
    numbers = spark.range(64 * SPLIT_PARTITIONS * rounds).select(F.col("id").cast("int").alias("key"))
    places = numbers.groupBy(F.pmod(F.hash("key"), F.lit(SPLIT_PARTITIONS))).agg(F.slice(F.array_sort(F.collect_list("key")), 1, max(1, rounds)).alias("keys")).collect()  # a row for each partition
    keys = sorted((i, k) for r in places for i, k in enumerate(r["keys"]))
    pairs = [F.lit(x) for split, (_, key) in zip(splits, keys) for x in (int(split), key)]
    return F.create_map(*pairs)[F.col("split")] if pairs else F.col("split")


def _side_by_side(rows: DataFrame, splits: list[int], features: list[str], target: str, month: str | None, naive: str | None, seed: int, trees: dict) -> DataFrame:
    """Fit on the train rows and predict the test rows of every split; ``rows`` have split and role."""
    keep = ([month] if month else []) + [target] + ([naive] if naive else [])
    needed = list(dict.fromkeys(features + keep))
    cast = [F.col(c) if c == month else F.col(c).cast("double").alias(c) for c in needed]
    schema = "split int, " + (f"`{month}` string, " if month else "") + "actual double, prediction double" + (", naive double" if naive else "")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([target, *features], ignore_index=True)
        train, test = pdf[(pdf["role"] == "train") & pdf[target].notna()], pdf[(pdf["role"] == "test") & pdf[target].notna()]
        out = {"split": test["split"]} | ({month: test[month]} if month else {}) | {"actual": test[target]}
        out["prediction"] = Booster.of(seed, **trees).fit(train[features].to_numpy(), train[target].to_numpy()).predict(test[features].to_numpy()) if len(train) and len(test) else np.nan
        return pd.DataFrame(out | ({"naive": test[naive]} if naive else {}))

    # Each split is much work on little data: a fixed number of partitions keeps small ones from being put together.
    key = _apart(rows.sparkSession, splits)
    return rows.select(key.alias("key"), "split", "role", *cast).repartition(SPLIT_PARTITIONS, "key").groupBy("key").applyInPandas(run, schema)


def _with_shared(rows: DataFrame, few: DataFrame, splits: list[int], own: list[str], shared: list[str], target: str, naive: str | None, seed: int, trees: dict) -> DataFrame:
    """As ``_side_by_side`` without months, for features ``own`` of each row and ``shared`` of its cell: ``rows`` have split, role and cell, ``few`` split, cell and ``shared``."""
    import pyarrow as pa

    naives = [naive] if naive else []
    needed = list(dict.fromkeys([*own, target, *naives]))
    schema = "split int, actual double, prediction double" + (", naive double" if naive else "")

    def floats(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(float, copy=False)  # NULL is NaN

    def run(rows: pa.Table, few: pa.Table) -> pa.Table:
        cells = few.column("of_cell").to_numpy()
        by_cell = np.argsort(cells)
        shape = np.stack([floats(few, c)[by_cell] for c in shared], axis=1)
        at = np.searchsorted(cells[by_cell], rows.column("cell").to_numpy()).astype(np.int32)
        y, test = floats(rows, target), rows.column("test").to_numpy()
        columns = lambda some: np.stack([floats(rows, c)[some] for c in own]).T if own else np.zeros((len(some), 0))
        learn, told = _ordered(y, columns, shape, at, np.flatnonzero(~test & ~np.isnan(y))), np.flatnonzero(test & ~np.isnan(y))
        predicted = np.full(len(told), np.nan)
        if len(learn) and len(told):
            predicted = Booster.of(seed, **trees).fit(columns(learn), y[learn], shape, at[learn]).predict(columns(told), shape, at[told])
        split = rows.column("split")[0].as_py() if len(y) else 0
        out = {"split": np.full(len(told), split, dtype=np.int32), "actual": y[told], "prediction": predicted}
        return pa.table(out | ({"naive": floats(rows, naive)[told]} if naive else {}))

    cast = [F.col(c).cast("double").alias(c) for c in needed]
    # The cells come from the same rows, so these columns need other names.
    key = _apart(rows.sparkSession, splits)
    left = rows.select(key.alias("key"), "split", (F.col("role") == "test").alias("test"), "cell", *cast).repartition(SPLIT_PARTITIONS, "key").groupBy("key")
    right = few.select(key.alias("of_key"), F.col("cell").alias("of_cell"), *[F.col(c).cast("double").alias(c) for c in shared]).repartition(SPLIT_PARTITIONS, "of_key").groupBy("of_key")
    return left.cogroup(right).applyInArrow(run, schema)


def _ordered(y: np.ndarray, columns, shared: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``rows`` by target and then by features, an order that doesn't hang on how they arrive; ``columns`` gives the own features of some rows."""
    rows = rows[np.argsort(y[rows], kind="stable")]
    again = np.diff(y[rows]) == 0
    tied = np.flatnonzero(np.concatenate([again, [False]]) | np.concatenate([[False], again]))
    if len(tied):
        # Cells with the same features are alike, so their rank may stand for the features.
        rank = np.unique(shared, axis=0, return_inverse=True)[1].reshape(-1) if shared.shape[1] else np.zeros(len(shared), dtype=np.int64)
        some = rows[tied]
        rows[tied] = some[np.lexsort([rank[at[some]], *columns(some).T[::-1], y[some]])]
    return rows


def evaluate_walk_forward(df: DataFrame, features: list[str], target: str, splits, naive: str = "lag_own_1m", month: str = "month", seed: int = 0, **trees) -> DataFrame:
    """Predictions of every split's test months with the naive one: (split, month, actual, prediction, naive)."""
    from kvartal.operators.validation import split_table

    plan = split_table(df.sparkSession, splits)
    if df.count() <= TASK_ROWS:
        rows = df.join(F.broadcast(plan.withColumnRenamed("month", "_m")), F.col(month) == F.col("_m")).drop("_m")  # the calendar's months by splits
        return _side_by_side(rows, list(range(len(splits))), features, target, month, naive, seed, trees).withColumnRenamed(month, "month")
    out = None
    for i, (train, test) in enumerate(splits):
        model = SparkPriceModel(features, target, seed, **trees).fit(df.where(F.col(month).isin(train)))
        part = model.predict(df.where(F.col(month).isin(test) & F.col(target).isNotNull())).select(F.lit(i).alias("split"), F.col(month).alias("month"), F.col(target).alias("actual"), "prediction", F.col(naive).alias("naive"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_folds(df: DataFrame, features: list[str], target: str, folds: DataFrame, naive: str | None = "lag_own_1m", exclude: list[str] | None = None, seed: int = 0, least_test: int = 1, least_train: int = 1, shared: list[str] | None = None, **trees) -> DataFrame:
    """Predictions of each fold by a model of the others: (split, actual, prediction, naive).

    Folds with fewer than ``least_test`` rows, or others with fewer than
    ``least_train``, are left out; so are cells without a fold.  Features in
    ``shared`` have one value in each cell and go to the tasks once a cell.
    """
    used = [c for c in features if c not in (exclude or [])]
    of_cells = [c for c in used if c in (shared or [])]
    places = folds.select("h3", "fold")
    if of_cells:
        places = places.withColumn("cell", F.row_number().over(w.Window.orderBy("h3")))  # a row for each cell
    rows = df.join(places, "h3").where("fold >= 0")
    counts = {r["fold"]: r["count"] for r in rows.where(F.col(target).isNotNull()).groupBy("fold").count().collect()}  # one row a fold
    total = sum(counts.values())
    kept = sorted(k for k, n in counts.items() if n >= least_test and total - n >= least_train)
    if total <= (CELL_TASK_ROWS if of_cells else TASK_ROWS):
        each = F.explode(F.array(*[F.lit(int(k)) for k in kept])) if kept else F.explode(F.array().cast("array<int>"))
        sided = rows.select("*", each.alias("split")).withColumn("role", F.when(F.col("fold") == F.col("split"), "test").otherwise("train"))
        if of_cells:
            few = rows.groupBy("cell").agg(*[F.first(c).alias(c) for c in of_cells]).select("*", each.alias("split"))
            return _with_shared(sided, few, kept, [c for c in used if c not in of_cells], of_cells, target, naive, seed, trees)
        return _side_by_side(sided, kept, used, target, None, naive, seed, trees)
    out = None
    for k in kept:
        model = SparkPriceModel(used, target, seed, **trees).fit(rows.where(F.col("fold") != k))
        part = model.predict(rows.where((F.col("fold") == k) & F.col(target).isNotNull()))
        part = part.select(F.col("fold").cast("int").alias("split"), F.col(target).alias("actual"), "prediction", *([F.col(naive).alias("naive")] if naive else []))
        out = part if out is None else out.unionByName(part)
    return out


def against_naive(predictions: DataFrame) -> DataFrame:
    """One row with pooled measures of model and naive prediction."""
    from kvartal.sources.tables import stored

    predictions = stored(predictions, "evaluated")  # else every model would be fitted once for each side
    own = metrics(predictions, "actual", "prediction")
    naive = metrics(predictions, "actual", "naive")
    return own.crossJoin(naive.select(*[F.col(c).alias("naive_" + c) for c in naive.columns]))  # one row each


def quantile_intervals(df: DataFrame, features: list[str], target: str, train: list[str], calibrate: list[str], month: str = "month", alpha: float = 0.2, seed: int = 0, **trees):
    """Conformal quantile intervals: (rows with q10, q50, q90, offset).

    Three boosters of the quantiles alpha / 2, one half and 1 - alpha / 2 are
    fitted on the ``train`` months; the offset that makes their bounds cover
    1 - alpha of the ``calibrate`` months, all of which come later, widens the
    bounds of every row.
    """
    from kvartal.operators import intervals
    from kvartal.sources.tables import stored

    intervals.check_windows(train, calibrate)
    rows = df
    for name, q in (("_low", alpha / 2), ("_mid", 0.5), ("_high", 1 - alpha / 2)):
        model = PriceModel(features, target, seed, q, **trees).fit(df.where(F.col(month).isin(train)))
        rows = model.predict(rows).withColumnRenamed("prediction", name)
    rows = stored(rows, "quantiles")
    seen = rows.where(F.col(month).isin(calibrate) & F.col(target).isNotNull())
    offset = intervals.conformal_offset(seen, target, "_low", "_high", alpha).first()
    if offset is None:
        raise ValueError("no rows to calibrate with")
    wide = intervals.widen(F.col("_low"), F.col("_mid"), F.col("_high"), F.lit(offset["offset"]))
    return rows.select(*df.columns, *wide), offset["offset"]
