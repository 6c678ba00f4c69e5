import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kvartal.operators import models
from kvartal.operators.boosting import Booster


def planted(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, -1.0) + rng.normal(0, 0.3, n)
    x[rng.random(x.shape) < 0.05] = np.nan
    return x, y


def test_booster_learns_and_takes_missing_values():
    x, y = planted()
    b = Booster(120, 4, 0.1).fit(x[:1000], y[:1000])
    p = b.predict(x[1000:])
    assert 1 - ((y[1000:] - p) ** 2).sum() / ((y[1000:] - y[1000:].mean()) ** 2).sum() > 0.85
    assert (b.predict(x[1000:]) == Booster(120, 4, 0.1).fit(x[:1000], y[:1000]).predict(x[1000:])).all()
    parts = b.contributions(x[1000:])
    total = b.start + b.value[:, 0].sum() + parts.sum(axis=1)
    assert np.allclose(total, p) and np.abs(parts).mean(axis=0).argmax() == 0
    assert Booster(3).fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0.0, 0.0]


def test_features_that_go_together_are_summed_once(monkeypatch):
    rng = np.random.default_rng(3)
    n, cells = 20_000, rng.normal(size=(40, 15))
    cells[5, 2] = np.nan
    at, own = rng.integers(0, 40, n), np.column_stack([rng.normal(size=n), rng.integers(1, 6, n), rng.integers(0, 2, n)])
    own[rng.random(n) < 0.05, 0] = np.nan
    y = np.nan_to_num(own[:, 0]) + cells[at, 0] + rng.normal(0, 0.3, n)
    x, count, summed = np.column_stack([own, cells[at]]), np.bincount, []
    monkeypatch.setattr(np, "bincount", lambda v, *a, **k: summed.append(len(v)) or count(v, *a, **k))
    b = Booster(5, 6, 0.1).fit(x, y)
    assert sum(summed) < 60 * n * 5  # row by row and feature by feature, 100 sums of each kind for a tree of these
    again = Booster(5, 6, 0.1).fit(own, y, cells, at)
    assert np.allclose(again.predict(own, cells, at), b.predict(x)) and (again.feature == b.feature).all()
    whole = Booster(1, 6, 1.0, rows=1.0, columns=1.0, penalty=1e-9).fit(x, y)
    leaf = pd.DataFrame({"y": y, "p": whole.predict(x)}).groupby("p").y.mean()
    assert len(leaf) == 64 and np.allclose(leaf.index, leaf)  # every leaf has the mean of its rows, though half of the sums are differences


def test_splits_that_part_rows_alike_go_to_the_first_feature():
    rng = np.random.default_rng(4)
    at, y = rng.integers(0, 4, 3000), rng.normal(1e5, 3e4, 3000)
    x = np.column_stack([at * 2.0, rng.normal(size=3000), at + 10.0])
    b = Booster(40, 4, 0.1, columns=1.0).fit(x, y)
    assert not (b.feature == 2).any() and (b.feature == 0).any()
    turned = np.random.default_rng(5).permutation(3000)
    one, two = (Booster(10, 4, 0.1, rows=1.0, columns=1.0).fit(x[o], y[o]) for o in (np.arange(3000), turned))
    assert (one.feature == two.feature).all() and (one.cut == two.cut).all()


def test_rows_of_equal_target_have_one_order():
    rng = np.random.default_rng(6)
    y, x, at = rng.integers(0, 9, 500).astype(float), rng.integers(0, 3, (500, 2)).astype(float), rng.integers(0, 5, 500)
    shared = rng.normal(size=(5, 2))
    x[::7, 0] = np.nan
    got = []
    for o in (np.arange(500), rng.permutation(500)):
        rows = models._ordered(y[o], lambda some: x[o][some], shared, at[o], np.arange(500))
        got.append(np.column_stack([y[o], x[o], shared[at[o]]])[rows])
    assert np.array_equal(*got, equal_nan=True) and (np.diff(got[0][:, 0]) >= 0).all()


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_quantile_booster_covers_its_share(q):
    x, y = planted(3000, 2)
    b = Booster(150, 3, 0.1, quantile=q).fit(x[:2000], y[:2000])
    assert abs((y[2000:] <= b.predict(x[2000:])).mean() - q) < 0.06


def table(spark, n=900):
    x, y = planted(n, 5)
    d = pd.DataFrame(x, columns=list("abcd")).assign(target=y, month=[f"2024-{1 + i % 12:02d}" for i in range(n)], h3=[f"c{i % 20}" for i in range(n)], lag_own_1m=y + 1)
    d.loc[::50, "target"] = np.nan
    return spark.createDataFrame(d)


def test_evaluations_side_by_side_are_those_of_single_models(spark):
    df, names, small = table(spark), list("abcd"), {"maxIter": 15, "maxDepth": 3, "stepSize": 0.2}
    months = sorted(r["month"] for r in df.select("month").distinct().collect())
    splits = [(months[:6], months[6:8]), (months[:8], months[8:])]
    got = models.evaluate_walk_forward(df, names, "target", splits, **small)
    assert got.columns == ["split", "month", "actual", "prediction", "naive"]
    one = models.PriceModel(names, "target", **small).fit(df.where(F.col("month").isin(splits[0][0]))).predict(df.where(F.col("month").isin(splits[0][1]) & ~F.isnan("target")))
    want = {round(r["target"], 9): r["prediction"] for r in one.collect()}
    mine = {round(r["actual"], 9): r["prediction"] for r in got.where("split = 0").collect()}
    assert mine == pytest.approx(want)
    folds = df.select("h3").distinct().withColumn("fold", F.when(F.col("h3") == "c0", -1).when(F.col("h3") == "c1", 7).otherwise(F.substring("h3", 2, 2).cast("int") % 3))
    out = models.evaluate_folds(df, names, "target", folds, least_test=60, **small)
    assert sorted(r["split"] for r in out.select("split").distinct().collect()) == [0, 1, 2]
    assert out.count() == df.where("h3 not in ('c0', 'c1') and not isnan(target)").count()


def test_each_split_has_a_partition_of_its_own(spark):
    p = models.SPLIT_PARTITIONS
    for splits in ([0, 1, 2, 3, 4], list(range(26)), [7, 9], list(range(p + 6))):
        df = spark.createDataFrame([(i,) for i in splits], "split int").withColumn("key", models._apart(spark, splits))
        got = df.repartition(p, "key").select("split", "key", F.spark_partition_id().alias("at")).toPandas()
        assert got.key.nunique() == len(splits) and got["at"].nunique() == min(p, len(splits)) and got["at"].value_counts().max() == -(-len(splits) // p)
    assert not spark.range(0).withColumn("split", F.lit(1)).select(models._apart(spark, [])).count()


def test_shared_features_go_to_the_tasks_once_a_cell(spark):
    df = table(spark).drop("d").withColumn("d", F.when(F.col("h3") != "c4", F.length("h3") + F.substring("h3", 2, 2).cast("double") % 5)).withColumn("near", F.col("target") + 1)
    folds = df.select("h3").distinct().withColumn("fold", F.when(F.col("h3") == "c0", -1).otherwise(F.substring("h3", 2, 2).cast("int") % 3))
    names, small = list("abcd"), {"maxIter": 15, "maxDepth": 3, "stepSize": 0.2, "naive": "near"}
    key = ["split", "actual", "prediction", "naive"]
    plain, shared = (models.evaluate_folds(df, names, "target", folds, shared=s, **small).select(key).orderBy("split", "actual").toPandas() for s in (None, ["d"]))
    assert len(plain) == len(shared) > 500 and np.allclose(plain, shared)
    none = models.evaluate_folds(df, names, "target", folds, shared=["d"], least_test=10_000, **small)
    assert none.columns == key and none.count() == 0


def test_quantile_intervals_cover(spark):
    df, months = table(spark, 1800).where(~F.isnan("target")), [f"2024-{i:02d}" for i in range(1, 13)]
    rows, _ = models.quantile_intervals(df, list("abcd"), "target", months[:7], months[7:10], maxIter=60, maxDepth=3, stepSize=0.1)
    seen = rows.where(F.col("month") > "2024-10").agg(F.avg(((F.col("target") >= F.col("q10")) & (F.col("target") <= F.col("q90"))).cast("int")), F.min(F.col("q50") - F.col("q10")), F.min(F.col("q90") - F.col("q50"))).first()
    assert 0.7 < seen[0] < 0.92 and seen[1] >= 0 and seen[2] >= 0
    with pytest.raises(ValueError):
        models.quantile_intervals(df, list("abcd"), "target", months[:8], months[7:10])


def test_contributions_table(spark):
    df = table(spark)
    model = models.PriceModel(list("abcd"), "target", maxIter=20, maxDepth=3).fit(df.where(~F.isnan("target")))
    top = [tuple(r) for r in models.mean_abs_contributions(model, df, 2).collect()]
    assert top[0][0] == "a" and len(top) == 2 and top[0][1] > top[1][1] > 0
    assert model.importances()[0][0] == "a"
    with pytest.raises(ValueError):
        models.PriceModel(["a"], "target").fit(df.limit(0))
