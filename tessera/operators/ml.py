"""Supervised models on Spark ML.

Training is distributed (Spark ML estimators); preparation is DataFrame
work: complete-case filter, label encoding (sorted distinct -> 0..k-1),
a deterministic hash split (stable under repartitioning, unlike
``randomSplit``), and standard scaling with the train set's population
mean / std. Metrics are plain aggregates over (actual, predicted), so they
can be checked against SQL.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import col
from tessera.functions.nulls import normalize_nulls
from tessera.functions.ranks import running_before
from tessera.functions.schema import numeric_cols
from tessera.operators import forest
from tessera.session import materialize, stage_input

# --- Fixed values: the analysed application's split and seed ----------------
TEST_SIZE = 0.2
RANDOM_STATE = 42
FOREST_TREES = 100
FOREST_BINS = 64
GBT_BINS = 32
# --- end of fixed values ---------------------------------------------------


def hash_split(df: DataFrame, test_frac: float = TEST_SIZE, seed: int = RANDOM_STATE) -> DataFrame:
    """Adds ``is_test``: the MD5 of the seed and all columns as text, joined by '|' and
    empty where NULL, has its first 32 bits modulo 10 000 below ``test_frac`` of that."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(c).cast("string"), F.lit("")) for c in df.columns])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("is_test", h < int(round(test_frac * 10_000)))


def label_encode(df: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    """Sorted distinct values -> 0..k-1, NULL -> k. A code is the value's place
    in the distributed order; no vocabulary passes through the driver."""
    out = df = stage_input(df, "label")
    for i, c in enumerate(cols):
        values = df.select(col(c).alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.max(F.lit(1)).cast("long").alias("_one"))
        codes = running_before(values, "_v", "_one").select(F.col("_v").alias(f"_v{i}"), F.col("before").cast("long").alias(f"_code{i}"))
        size = codes.agg(F.count(F.lit(1)).alias(f"_size{i}"))
        out = out.join(codes, col(c) == F.col(f"_v{i}"), "left").crossJoin(F.broadcast(size))
    return out.select(*[col(c) for c in df.columns], *[F.coalesce(f"_code{i}", f"_size{i}").alias(c + suffix) for i, c in enumerate(cols)])


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                   suffix: str = "_scaled") -> DataFrame:
    """(x − mean) / σ with σ the population std (ddof 0) of ``fit_on``
    (default: ``df``); a constant column scales to 0."""
    src = fit_on if fit_on is not None else df
    stats = src.agg(*[F.avg(col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(stats))
    scaled = [F.coalesce(F.try_divide(col(c).cast("double") - F.col(f"_m{i}"),
                                      F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}"))), F.lit(0.0)).alias(c + suffix)
              for i, c in enumerate(cols)]
    return j.select(*[col(c) for c in df.columns], *scaled)


def prepare(df: DataFrame, target: str, features: list[str], encode_target: bool = False,
            test_frac: float = TEST_SIZE, seed: int = RANDOM_STATE) -> DataFrame:
    """select -> drop incomplete rows -> encode text features (and target) ->
    hash split -> scale with train statistics -> ``features`` vector.
    Columns: label, features, is_test, plus the scaled feature columns."""
    d = normalize_nulls(df.select(*[col(c) for c in features + [target]])).dropna()
    strings = [f.name for f in d.schema.fields if isinstance(f.dataType, T.StringType) and f.name in features]
    if strings:
        d = label_encode(d, strings)
        d = d.drop(*strings)
        for c in strings:
            d = d.withColumnRenamed(c + "_code", c)
    if encode_target and isinstance(df.schema[target].dataType, T.StringType):
        d = label_encode(d, [target]).drop(target).withColumnRenamed(target + "_code", target)
    d = hash_split(d.select(*[col(c).cast("double").alias(c) for c in features],
                            col(target).cast("double").alias("label")), test_frac, seed)
    scaled = standard_scale(d, features, fit_on=d.where(~F.col("is_test")))
    sc = [c + "_scaled" for c in features]
    va = VectorAssembler(inputCols=sc, outputCol="features")
    return va.transform(scaled).select("label", "features", "is_test", *sc)


def _regressor(name: str, n_train: int, y_std: float, max_depth: int = 10):
    if name == "linear":
        return LinearRegression(regParam=0.0, solver="normal")
    if name == "ridge":  # sklearn alpha=1 in Spark's label-scaled objective
        return LinearRegression(regParam=(y_std / max(n_train, 1)), elasticNetParam=0.0, standardization=False,
                                solver="normal")
    if name == "lasso":
        return LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False, tol=1e-10,
                                maxIter=1000)
    if name == "rf":
        return RandomForestRegressor(numTrees=FOREST_TREES, seed=RANDOM_STATE, featureSubsetStrategy="all",
                                     maxDepth=max_depth, maxBins=FOREST_BINS)
    if name == "gbt":
        return GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=RANDOM_STATE, maxBins=GBT_BINS)
    raise ValueError(f"unknown regressor {name!r}")


def _boosted_on_cells(train: DataFrame, test: DataFrame, cols: list[str]):
    """(model, ``test`` with the features that it knows): boosting by squared error sees of rows with the same bins
    only their number and mean label, so these weighted rows take the place of the training rows."""
    cuts = forest.bin_cuts(train, cols, GBT_BINS)
    codes = [f"b{i}" for i in range(len(cols))]
    va = VectorAssembler(inputCols=codes, outputCol="features")
    cells = forest.binned(train, cols, cuts).groupBy(*codes).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.avg("label").alias("label"))
    cells = materialize(va.transform(cells), "ml_cells")
    # Spark ML looks for splits in a sample of maxBins ** 2 rows: enough of them that no bin is missed
    seen = max(GBT_BINS, min(1024, math.isqrt(cells.count()) + 1))
    est = _regressor("gbt", 0, 0.0).setMaxBins(seen).setWeightCol("weight")
    return est.fit(cells), va.transform(forest.binned(test, cols, cuts))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       digits: int = 4) -> DataFrame:
    """MAE, RMSE, R² (1 − SS_res/SS_tot) over (actual, predicted)."""
    e = F.col(label) - F.col(prediction)
    ybar = pred.agg(F.avg(label).alias("_ybar"))
    j = pred.crossJoin(F.broadcast(ybar))
    return j.agg(F.round(F.avg(F.abs(e)), digits).alias("mae"),
                 F.round(F.sqrt(F.avg(e * e)), digits).alias("rmse"),
                 F.round(1 - F.try_divide(F.sum(e * e), F.sum((F.col(label) - F.col("_ybar")) ** 2)),
                         digits).alias("r2"),
                 F.count(F.lit(1)).cast("long").alias("n"))


def _class_table(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class: tp, predicted count, actual count (one shuffle on class)."""
    both = F.array(F.struct(F.col(label).cast("double").alias("c"), F.lit(1).alias("is_actual"),
                            (F.col(label) == F.col(prediction)).cast("int").alias("hit")),
                   F.struct(F.col(prediction).cast("double").alias("c"), F.lit(0).alias("is_actual"),
                            F.lit(0).alias("hit")))
    x = pred.select(F.explode(both).alias("e")).select("e.*")
    return x.groupBy("c").agg(F.sum("hit").alias("tp"), F.sum("is_actual").alias("n_act"),
                              F.sum(1 - F.col("is_actual")).alias("n_pred"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall, F1: binary (positive class 1) when the
    actual labels hold at most two classes, else support-weighted; a zero
    denominator gives 0."""
    t = _class_table(pred, label, prediction)
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_act")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    t = t.select("c", "tp", "n_act", prec.alias("p"), rec.alias("r"), f1.alias("f"))
    a = t.agg(F.sum("tp").alias("_hits"), F.sum("n_act").alias("_n"),
              F.count_if(F.col("n_act") > 0).alias("_k"),
              *[F.sum(F.col("n_act") * F.col(m)).alias(f"_w{m}") for m in ("p", "r", "f")],
              *[F.max(F.when(F.col("c") == 1.0, F.col(m))).alias(f"_b{m}") for m in ("p", "r", "f")])
    binary = F.col("_k") <= 2
    pick = lambda m: F.when(binary, F.coalesce(F.col(f"_b{m}"), F.lit(0.0))).otherwise(
        F.col(f"_w{m}") / F.col("_n"))
    return a.select(F.round(F.col("_hits") / F.col("_n"), digits).alias("accuracy"),
                    F.round(pick("p"), digits).alias("precision"), F.round(pick("r"), digits).alias("recall"),
                    F.round(pick("f"), digits).alias("f1"),
                    F.when(binary, "binary").otherwise("weighted").alias("average"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (pred.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
            .agg(F.count(F.lit(1)).cast("long").alias("count")))


def _importance(model, features: list[str], spark) -> DataFrame:
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficientMatrix"):
        vals = [abs(v) for v in model.coefficientMatrix.toArray()[0].tolist()]
    elif hasattr(model, "coefficients"):
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    else:
        return spark.createDataFrame([], "feature string, importance double")
    return _importance_rows(vals, features, spark)


def _importance_rows(vals: list[float], features: list[str], spark) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc())


def train_regression(df: DataFrame, target: str, features: list[str], model: str = "rf", max_depth: int = 10):
    """Fit on the train split, score the test split.
    Returns (metrics frame, importance frame, predictions frame).

    ``max_depth`` limits the trees of the random forest. It is grown from the
    counted cells of the binned features (``operators/forest.py``); where they are
    too many for that, by Spark ML, which allows 30 levels and passes over the data
    for each."""
    # written once to the shared checkpoint folder: fit, scoring and metrics
    # then read it instead of recomputing encoding, split and scaling
    prep = materialize(prepare(df, target, features), "ml_prep")
    train, test = prep.where(~F.col("is_test")), prep.where(F.col("is_test"))
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s"), F.avg("label").alias("m")).first()
    scaled = [c + "_scaled" for c in features]
    on_cells = forest.fit_forest(train, scaled, FOREST_TREES, max_depth, FOREST_BINS, RANDOM_STATE, st["m"]) if model == "rf" and st["n"] else None
    if model == "gbt" and st["n"]:
        fitted, test = _boosted_on_cells(train, test, scaled)
        imp, pred = _importance(fitted, features, df.sparkSession), fitted.transform(test).select("label", "prediction")
    elif on_cells is not None:
        imp, pred = _importance_rows(on_cells.importances, features, df.sparkSession), on_cells.predict(test)
    else:
        fitted = _regressor(model, st["n"], st["s"] or 0.0, max_depth).fit(train)
        imp, pred = _importance(fitted, features, df.sparkSession), fitted.transform(test).select("label", "prediction")
    m = regression_metrics(pred).select(F.lit(model).alias("model"), "mae", "rmse", "r2",
                                        F.lit(st["n"]).cast("long").alias("n_train"),
                                        F.col("n").alias("n_test"))
    return m, imp, pred


def feature_regression(df: DataFrame, target: str | None = None, features: list[str] | None = None, max_depth: int = 10):
    """Forecast of a table without dates: a random forest of the ``target`` (default: the first numeric column) on
    ``features`` (default: the first two other numeric ones). Returns what ``train_regression`` does; ValueError with
    fewer than two numeric columns or no feature."""
    nums = numeric_cols(df)
    if len(nums) < 2:
        raise ValueError("feature regression needs at least two numeric columns")
    target = nums[0] if target is None else target
    features = [c for c in nums if c != target][:2] if features is None else features
    if not features or target in features:
        raise ValueError("feature regression needs features other than its target")
    return train_regression(df, target, features, "rf", max_depth)


def _rff(prep: DataFrame, n_features: int, dim: int = 100, seed: int = RANDOM_STATE) -> DataFrame:
    """Random Fourier features approximating an RBF kernel with
    gamma = 1 / (n_features · Var(X)) (the 'scale' rule) on the scaled inputs
    (whose pooled variance is ~1)."""
    import numpy as np
    rng = np.random.default_rng(seed)
    gamma = 1.0 / max(n_features, 1)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(dim, n_features))
    b = rng.uniform(0, 2 * math.pi, size=dim)
    arr = vector_to_array(F.col("features"))
    z = [F.cos(sum(F.lit(float(w[i, j])) * arr[j] for j in range(n_features)) + F.lit(float(b[i])))
         * math.sqrt(2.0 / dim) for i in range(dim)]
    x = prep.select("label", "is_test", F.array(*z).alias("_z"))
    return x.select("label", "is_test", array_to_vector("_z").alias("features"))


def train_classification(df: DataFrame, target: str, features: list[str], model: str = "rf",
                         max_depth: int = 12):
    """Returns (metrics frame, importance frame, predictions frame).

    ``max_depth`` limits the trees of the random forest; Spark allows up to 30,
    and every level is a pass over the data."""
    prep = prepare(df, target, features, encode_target=True)
    if model == "svm":
        prep = _rff(prep, len(features))
    prep = materialize(prep, "ml_prep")
    train, test = prep.where(~F.col("is_test")), prep.where(F.col("is_test"))
    n_train = train.count()
    k = train.select("label").distinct().count()
    if model == "gbt" and k > 2:  # Spark's booster knows two classes
        from tessera.operators import boosting
        booster = boosting.fit(train)
        pred = boosting.predict(booster, test).select("label", "prediction")
        imp = df.sparkSession.createDataFrame(list(zip(features, boosting.importance(booster))), "feature string, importance double")
        return classification_metrics(pred).select(F.lit(model).alias("model"), "*"), imp.orderBy(F.col("importance").desc()), pred
    if model == "logistic":
        est = LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                 standardization=False, family="auto")
    elif model == "rf":
        est = RandomForestClassifier(numTrees=100, seed=RANDOM_STATE, maxDepth=max_depth, maxBins=64)
    elif model == "gbt":
        est = GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=RANDOM_STATE)
    elif model == "svm":
        base = LinearSVC(maxIter=50, tol=1e-4, regParam=1.0 / max(n_train, 1))
        est = base if k <= 2 else OneVsRest(classifier=base)
    elif model == "knn":
        from tessera.operators.knn import knn_classify
        pred = knn_classify(train, test, k=5)
        m = classification_metrics(pred)
        return (m.select(F.lit(model).alias("model"), "*"),
                df.sparkSession.createDataFrame([], "feature string, importance double"), pred)
    else:
        raise ValueError(f"unknown classifier {model!r}")
    fitted = est.fit(train)
    pred = fitted.transform(test).select("label", "prediction")
    m = classification_metrics(pred).select(F.lit(model).alias("model"), "*")
    imp = _importance(fitted, features, df.sparkSession) if model != "svm" else \
        df.sparkSession.createDataFrame([], "feature string, importance double")
    return m, imp, pred


def chrono_split(df: DataFrame, ts: str, test_frac: float = TEST_SIZE) -> DataFrame:
    """Adds ``is_test``: the last ceil(test_frac·n) rows in time order.

    Rows are ordered by (time, all columns); rows without a time come first and
    are kept. Equal rows are one counted entry of the distributed order, and only
    one entry can straddle the border: its copies are made anew, so many for
    training and the rest for testing. Every other row is compared with it.
    """
    keys = [F.unix_micros(col(ts).cast("timestamp")).alias("_t"), *[col(c) for c in df.columns]]
    d = stage_input(df, "chrono").withColumn("_key", F.struct(*keys))
    counts = d.groupBy("_key").agg(F.count(F.lit(1)).alias("_cnt"))
    n = counts.agg(F.coalesce(F.sum("_cnt"), F.lit(0)).alias("_n"))
    train = (F.col("_n") - F.ceil(F.col("_n") * test_frac)).cast("long")
    placed = running_before(counts, "_key", "_cnt").crossJoin(F.broadcast(n))
    # the entry that holds the first test row, and how many of its copies still train
    edge = materialize(placed.where((F.col("before") <= train) & (train < F.col("before") + F.col("_cnt"))).select(
        F.col("_key").alias("_edge"), F.col("_cnt"), (train - F.col("before")).alias("_train")), "chrono-edge")
    border = edge.first()
    names = [col(c) for c in df.columns]
    if border is None:  # no rows, or none to test
        return df.withColumn("is_test", F.lit(False))
    one = F.broadcast(edge.select("_edge"))
    rest = d.crossJoin(one).where(F.col("_key") != F.col("_edge")).select(*names, (F.col("_key") > F.col("_edge")).alias("is_test"))
    copies = df.sparkSession.range(border["_cnt"]).crossJoin(F.broadcast(edge))
    same = copies.select(*[F.col(f"_edge.`{c}`").alias(c) for c in df.columns], (F.col("id") >= F.col("_train")).alias("is_test"))
    return rest.unionByName(same)
