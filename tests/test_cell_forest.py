import numpy as np
import pytest

from tessera.operators import forest, ml


def _rows(spark, n=600, parts=4):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 40, n), rng.normal(size=n).round(3)
    label = np.where(x < 13, 2.0, 7.0) + 3.0 * (y > 0.4) + rng.normal(0, 0.2, n)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, label)]
    return spark.createDataFrame(rows, "x double, y double, label double").repartition(parts)


def test_one_tree_on_cells_is_spark_mls_tree(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    df = _rows(spark)
    cuts = forest.bin_cuts(df, ["x", "y"], 64)
    assert len(cuts[0]) == 39 and len(cuts[1]) <= 63
    cells = forest.in_cells(df, ["x", "y"], cuts).toPandas()
    size = 40 * (len(cuts[1]) + 1)
    n, s = np.bincount(cells["cell"], minlength=size).astype(float), np.bincount(cells["cell"], cells["label"], size)
    value, gains = forest.grow(n, s, [40, len(cuts[1]) + 1], 5)
    data = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    tree = DecisionTreeRegressor(maxDepth=5, maxBins=64).fit(data)
    want = tree.transform(data).select("x", "y", "prediction").toPandas()
    code = np.searchsorted(cuts[0], want["x"]) * (len(cuts[1]) + 1) + np.searchsorted(cuts[1], want["y"])
    assert value[code] == pytest.approx(want["prediction"].to_numpy(), abs=1e-9)
    assert gains / gains.sum() == pytest.approx(tree.featureImportances.toArray(), abs=1e-9)


def test_bag_counts_are_poisson_and_go_by_row_and_tree():
    key = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    for rate in (1, 3, forest.COPIES):
        drawn = forest.bag_counts(key, np.full(len(key), rate), 7)
        assert drawn.mean() == pytest.approx(rate, rel=0.02) and drawn.var() == pytest.approx(rate, rel=0.05)
        assert (drawn[::-1] == forest.bag_counts(key[::-1], np.full(len(key), rate), 7)).all()
        assert abs(np.corrcoef(drawn.T)[0, 1:]).max() < 0.05


def test_copies_of_a_row_are_drawn_each_for_itself(spark):
    df = spark.createDataFrame([(0, 1.0)], "cell int, label double").crossJoin(spark.range(2_000)).select("cell", "label")
    n = forest.bags(df, 50, 42, 0.0).groupBy("tree").sum("n", "s").toPandas()
    assert len(n) == 50 and (n["sum(n)"] == n["sum(s)"]).all()
    assert n["sum(n)"].mean() == pytest.approx(2_000, rel=0.02) and 20 < n["sum(n)"].std() < 80


def test_forest_is_the_same_whatever_the_partitions(spark):
    found = []
    for parts in (1, 7):
        df = _rows(spark, parts=parts)
        metrics, imp, pred = ml.train_regression(df, "label", ["x", "y"], "rf", max_depth=6)
        found.append((metrics.first(), sorted((r["feature"], round(r["importance"], 9)) for r in imp.collect()),
                      sorted((r["label"], round(r["prediction"], 9)) for r in pred.collect())))
    assert found[0] == found[1]
    assert found[0][0]["r2"] > 0.95 and found[0][0]["n_test"] == len(found[0][2])
    assert sum(v for _, v in found[0][1]) == pytest.approx(1.0)


def test_more_cells_than_a_task_holds_go_to_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(forest, "MAX_CELLS", 8)
    metrics, imp, pred = ml.train_regression(_rows(spark), "label", ["x", "y"], "rf", max_depth=3)
    assert metrics.first()["r2"] > 0.8 and imp.count() == 2 and pred.count() == metrics.first()["n_test"]


def test_boosting_on_cells_is_boosting_on_rows(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 20, 800), rng.integers(0, 9, 800)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, x * 2.0 + (y > 4) * 5.0 + rng.normal(0, 1, 800))]
    df = spark.createDataFrame(rows, "x double, y double, label double")
    model, test = ml._boosted_on_cells(df, df, ["x", "y"])
    got = model.transform(test).select("label", "prediction").orderBy("label").toPandas()
    data = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    plain = GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=ml.RANDOM_STATE).fit(data)
    want = plain.transform(data).orderBy("label").toPandas()
    assert got["prediction"].to_numpy() == pytest.approx(want["prediction"].to_numpy(), abs=1e-6)
    assert model.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-6)
