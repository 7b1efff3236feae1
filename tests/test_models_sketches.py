"""Model store and mergeable profiles."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.colstats import moments_of_counts
from tessera.operators import sketches
from tessera.session import scratch_path
from tessera.sources import history, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(float(x), "abc"[i % 3], 3 * float(x) + i % 3) for i, x in enumerate(rng.normal(size=300))]
    return spark.createDataFrame(data, "x double, kind string, y double")


def test_train_store_load_and_score_in_a_fresh_session(spark, rows):
    base = scratch_path(spark, "test-models")
    first, metrics = models.train_and_store(spark, base, "m", rows, "y", ["x", "kind"])
    second, _ = models.train_and_store(spark, base, "m", rows, "y", ["x"], model="ridge")
    assert (first, second) == (1, 2) and metrics["r2"] == pytest.approx(1.0)
    other = spark.newSession()
    again = other.createDataFrame(rows.collect(), rows.schema)
    scored = models.score(other, base, "m", again, version=1)
    assert scored.columns == ["x", "kind", "y", "prediction"]
    assert all(r["prediction"] == pytest.approx(r["y"], abs=1e-6) for r in scored.collect())
    newest = {r["x"]: r["prediction"] for r in models.score(spark, base, "m", rows).collect()}
    assert any(abs(newest[r["x"]] - r["y"]) > 0.1 for r in rows.collect())  # version 2 does not know the kind
    _, codes, encoding = models.load(spark, base, "m", 1)
    assert [tuple(r) for r in codes.orderBy("code").collect()] == [("kind", "a", 0), ("kind", "b", 1), ("kind", "c", 2)] and encoding.features == ["x", "kind"]
    with pytest.raises(KeyError):
        models.load(spark, base, "m", 3)
    listed = {(r["name"], r["version"], r["model_type"]) for r in history.list_models(spark, base).collect()}
    assert listed == {("m", 1, "linear"), ("m", 2, "ridge")}


def test_unknown_and_missing_values_have_scores(spark, rows):
    base = scratch_path(spark, "test-models")
    models.train_and_store(spark, base, "m", rows, "y", ["x", "kind"], model="rf", max_depth=4)
    odd = spark.createDataFrame([(0.0, "zzz"), (0.0, None), (None, "a")], "x double, kind string")
    got = [r["prediction"] for r in models.score(spark, base, "m", odd).collect()]
    assert sum(p is None for p in got) == 1 and all(np.isfinite(p) for p in got if p is not None)


def test_registry_reads_rows_without_the_later_columns(spark, rows):
    base = scratch_path(spark, "test-models")
    old = spark.createDataFrame([("m", "reg", "{}")], "name string, model_type string, metrics string").withColumn("created_at", F.current_timestamp())
    history.register_models(spark, base, old)
    version, _ = models.train_and_store(spark, base, "m", rows, "y", ["x"])
    assert version == 2 and models.load(spark, base, "m")[2].target == "y"


def _figures(state):
    return {r["column_name"]: r for r in sketches.read_state(state).collect()}


@pytest.mark.parametrize("held", [4, 1024])
def test_merged_profile_is_the_profile_of_both(spark, held):
    n = 6_000
    df = spark.range(n).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 700).cast("string"))).alias("s"),
                               F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 7).alias("k"))
    part = F.col("x") < 1_500
    merged = sketches.merge_states(sketches.profile_state(df.where(part), held).unionByName(sketches.profile_state(df.where(~part), held)), held)
    whole, both = _figures(sketches.profile_state(df, held)), _figures(merged)
    for c in df.columns:
        assert [whole[c][x] for x in ("rows", "missing", "mean", "least", "greatest")] == pytest.approx([both[c][x] for x in ("rows", "missing", "mean", "least", "greatest")], nan_ok=True) \
            if c != "s" else (whole[c]["rows"], whole[c]["missing"]) == (both[c]["rows"], both[c]["missing"])
        exact = df.select(c).distinct().where(F.col(c).isNotNull()).count()
        assert abs(both[c]["distinct"] - exact) <= 0.06 * exact + 1
    for q in (25, 50, 75):
        assert abs(both["x"][f"q{q}"] / n - q / 100) < 0.02
    top = both["s"]["top"][0]
    assert top["value"] == "hot" and 2_000 - both["s"]["error"] <= top["count"] <= 2_000
    assert both["s"]["error"] <= n / (held + 1) + 1 and (held < 701 or (both["s"]["error"] == 0 and top["count"] == 2_000))


def test_states_of_empty_tables(spark):
    df = spark.createDataFrame([], "x double, s string")
    state = sketches.profile_state(df)
    for s in (state, sketches.merge_states(state.unionByName(state))):
        got = _figures(s)
        assert got["x"]["rows"] == 0 and got["s"]["distinct"] == 0 and got["s"]["top"] == []


def test_moments_do_not_cancel(spark):
    from pandas import Series
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2.0, size=5_000), 3) + 1e7
    counts = spark.createDataFrame([("a", float(v), 1) for v in x], "column_name string, value double, cnt long").groupBy("column_name", "value").agg(F.sum("cnt").alias("cnt")).repartition(7)
    got, s = moments_of_counts(counts)["a"], Series(x)
    assert got["n"] == 5_000 and got["min"] == x.min() and got["max"] == x.max()
    assert [got["mean"], got["var"], got["skew"], got["kurt"]] == pytest.approx([s.mean(), s.var(), s.skew(), s.kurt()], rel=1e-6)
