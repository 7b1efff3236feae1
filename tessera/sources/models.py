"""Model store: fitted models with all that scoring needs, by name and version.

A stored model is a folder under the shared base:

* ``model/``  the fitted Spark ML model, in Spark ML's own format;
* ``codes/``  (feature, value, code) of every text feature, a table that is
  joined to the rows to be scored (no vocabulary passes through the driver).

Target, features, their scaling (a row per feature) and the training
parameters are JSON in the registry row, which is appended last and names the
folder: a save that is cut short leaves nothing that a reader would find.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import col
from tessera.functions.nulls import normalize_nulls
from tessera.functions.ranks import running_before
from tessera.operators import ml
from tessera.session import materialize
from tessera.sources import history


@dataclass
class Encoding:
    """How rows become feature vectors: per feature its kind, the number of codes, mean and population deviation."""

    target: str
    features: list[str]
    texts: list[str]
    levels: dict[str, int]
    mean: dict[str, float]
    std: dict[str, float]


def _codes(d: DataFrame, texts: list[str]) -> DataFrame:
    """(feature, value, code): sorted distinct values -> 0.. of each text feature, from the distributed order."""
    if not texts:
        return d.sparkSession.createDataFrame([], "feature string, value string, code long")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).alias("value")) for c in texts])
    values = d.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.lit(1).cast("long").alias("n"))
    return running_before(values, "value", "n", ["feature"]).select("feature", "value", F.col("before").cast("long").alias("code"))


def _numbers(rows: DataFrame, codes: DataFrame, e: Encoding) -> DataFrame:
    """``rows`` plus _f0, _f1, ...: each feature as a number; a value that training did not see is one more code."""
    for i, c in enumerate(e.features):
        if c in e.texts:
            code = codes.where(F.col("feature") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
            rows = rows.join(code, F.col(f"_x{i}") == F.col(f"_v{i}"), "left").withColumn(f"_f{i}", F.coalesce(f"_c{i}", F.lit(e.levels.get(c, 0))).cast("double")).drop(f"_v{i}", f"_c{i}")
        else:
            rows = rows.withColumn(f"_f{i}", F.col(f"_x{i}").cast("double"))
    return rows


def _vector(e: Encoding):
    scaled = [(F.col(f"_f{i}") - F.lit(e.mean[c])) / F.lit(e.std[c]) if e.std[c] else F.lit(0.0) for i, c in enumerate(e.features)]
    return array_to_vector(F.array(*scaled))


def prepare(df: DataFrame, target: str, features: list[str], test_frac: float = ml.TEST_SIZE) -> tuple[DataFrame, DataFrame, Encoding]:
    """(rows with label, features and is_test; codes; encoding) of the complete rows of ``df``."""
    d = normalize_nulls(df.select(*[col(c) for c in features + [target]])).dropna()
    texts = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    codes = materialize(_codes(d, texts), "codes")
    levels = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per feature
    e = Encoding(target, list(features), texts, levels, {}, {})
    split = ml.hash_split(d, test_frac)
    raw = split.select(*[col(c).alias(f"_x{i}") for i, c in enumerate(features)], col(target).cast("double").alias("label"), "is_test")
    raw = materialize(_numbers(raw, codes, e), "numbers")
    train = raw.where(~F.col("is_test"))
    stats = train.agg(*[F.avg(f"_f{i}").alias(f"m{i}") for i in range(len(features))], *[F.stddev_pop(f"_f{i}").alias(f"s{i}") for i in range(len(features))]).first()
    for i, c in enumerate(features):
        e.mean[c], e.std[c] = float(stats[f"m{i}"] or 0.0), float(stats[f"s{i}"] or 0.0)
    return raw.select("label", _vector(e).alias("features"), "is_test"), codes, e


def save(spark: SparkSession, base: str, name: str, model_type: str, model: Transformer, codes: DataFrame, e: Encoding,
         metrics: dict | None = None, params: dict | None = None) -> int:
    """Store a fitted model under the next version of ``name``; the version."""
    folder = f"{base.rstrip('/')}/models/{uuid.uuid4().hex}"
    PipelineModel([model]).write().save(f"{folder}/model")
    codes.write.parquet(f"{folder}/codes")
    row = spark.createDataFrame([(name, model_type, json.dumps(metrics or {}), json.dumps(params or {}), json.dumps(asdict(e)), folder)],
                                "name string, model_type string, metrics string, params string, encoding string, path string")
    new = history.register_models(spark, base, row.withColumn("created_at", F.current_timestamp()))
    return int(new.where(F.col("path") == folder).first()["version"])


def load(spark: SparkSession, base: str, name: str, version: int | None = None) -> tuple[PipelineModel, DataFrame, Encoding]:
    """(model, codes, encoding) of a version, or of the newest one; KeyError if there is none."""
    rows = history.read(spark, base, "model_registry").where((F.col("name") == name) & F.col("path").isNotNull())
    if version is not None:
        rows = rows.where(F.col("version") == version)
    row = rows.orderBy(F.col("version").desc()).first()
    if row is None:
        raise KeyError(f"no stored model {name!r}" + (f", version {version}" if version is not None else ""))
    return PipelineModel.load(f"{row['path']}/model"), spark.read.parquet(f"{row['path']}/codes"), Encoding(**json.loads(row["encoding"]))


def score(spark: SparkSession, base: str, name: str, df: DataFrame, version: int | None = None) -> DataFrame:
    """``df`` plus ``prediction`` of a stored model; NULL where a numeric feature is missing. A text that training did
    not see, or a missing one, has the code after the last."""
    model, codes, e = load(spark, base, name, version)
    d = normalize_nulls(df)
    rows = d.select(F.struct("*").alias("_row"), *[col(c).alias(f"_x{i}") for i, c in enumerate(e.features)])
    rows = _numbers(rows, codes, e)
    known = [F.col(f"_f{i}").isNotNull() for i in range(len(e.features))]
    whole = known[0]
    for k in known[1:]:
        whole = whole & k
    filled = rows.select("_row", whole.alias("_whole"), *[F.coalesce(f"_f{i}", F.lit(0.0)).alias(f"_f{i}") for i in range(len(e.features))])
    scored = model.transform(filled.select("_row", "_whole", _vector(e).alias("features")))
    return scored.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], F.when(F.col("_whole"), F.col("prediction")).alias("prediction"))


def train_and_store(spark: SparkSession, base: str, name: str, df: DataFrame, target: str, features: list[str], model: str = "linear",
                    max_depth: int = 10, test_frac: float = ml.TEST_SIZE) -> tuple[int, dict]:
    """Train a regression, measure it on the test split and store it: (version, metrics)."""
    rows, codes, e = prepare(df, target, features, test_frac)
    rows = materialize(rows, "ml_prep")
    train, test = rows.where(~F.col("is_test")), rows.where(F.col("is_test"))
    size = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    fitted = ml._regressor(model, size["n"], size["s"] or 0.0, max_depth).fit(train)
    metrics = ml.regression_metrics(fitted.transform(test).select("label", "prediction")).first().asDict()
    params = {"max_depth": max_depth, "test_frac": test_frac, "seed": ml.RANDOM_STATE, "n_train": size["n"]}
    return save(spark, base, name, model, fitted, codes, e, metrics, params), metrics
