"""Month forests (exact, per series) and boosting with more than two classes."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import boosting, forecast as fc, ml


def _grown(x, y, at):
    """One tree grown by variance until its leaves are pure, as a brute force."""
    if len(set(y)) == 1:
        return y[0]
    xs = sorted(set(x))
    best = min(((a + b) / 2 for a, b in zip(xs, xs[1:])), key=lambda c: sum(len(s) * np.var(s) for s in (y[x <= c], y[x > c])))
    side = x <= best if at <= best else x > best
    return _grown(x[side], y[side], at)


def test_forest_is_the_mean_of_fully_grown_trees():
    rng = np.random.default_rng(1)
    value = rng.normal(size=23)
    at = np.arange(26)
    samples = fc.bootstrap(23, 40, 5)
    want = [np.mean([_grown(s.astype(float), value[s], a) for s in samples]) for a in at]
    assert fc.forest_values(value, at, 40, 5) == pytest.approx(want, abs=1e-6)


def test_draws_are_even_and_differ_between_trees():
    d = fc.bootstrap(50, 2000, 42)
    share = np.bincount(d.ravel(), minlength=50) / d.size
    assert d.min() == 0 and d.max() == 49 and abs(share - 0.02).max() < 0.002
    distinct = np.array([len(set(r)) for r in d]) / 50
    assert abs(distinct.mean() - (1 - (1 - 1 / 50) ** 50)) < 0.01 and len({tuple(r) for r in d}) == 2000


@pytest.fixture(scope="module")
def months(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"20{y:02d}-{m:02d}-{day:02d}", float(v)) for k, years in (("a", 3), ("b", 5), ("c", 1)) for y in range(years) for m in range(1, 13)
            for day, v in ((3, rng.normal()), (17, rng.normal()))] + [("short", "2000-01-01", 1.0), ("short", "2000-02-01", 2.0), (None, "2000-01-01", 9.0)]
    return spark.createDataFrame(rows, "k string, day string, v double")


def test_a_series_has_the_same_forest_beside_others(months):
    for fn in (fc.forecast_rf, fc.forecast_holdout_rf):
        for part in (0, 1):
            alone = {k: sorted(tuple(r) for r in fn(months.where(F.col("k") == k), "day", "v")[part].collect()) for k in ("a", "b", "c", "short")}
            together = {}
            for r in fn(months, "day", "v", by=["k"])[part].collect():
                together.setdefault(r["k"], []).append(tuple(r)[1:])
            assert {k: sorted(v) for k, v in together.items()} == {k: v for k, v in alone.items() if v}
            assert ("short" in together) == (fn is fc.forecast_rf)


def test_forest_of_nothing(months):
    assert all(not part.collect() for part in fc.forecast_rf(months.where("false"), "day", "v"))
    assert all(not part.collect() for part in fc.forecast_holdout_rf(months.where("false"), "day", "v", by=["k"]))
    with pytest.raises(ValueError):
        fc.forecast_rf(months, "day", "v", periods=0)


def _vectors(spark, data, d):
    cols = ", ".join(f"x{i} double" for i in range(d))
    return spark.createDataFrame(data, f"label double, {cols}").select("label", array_to_vector(F.array(*[f"x{i}" for i in range(d)])).alias("features"))


def test_first_round_in_closed_form(spark):
    rows = _vectors(spark, [(float(k), float(k)) for k in (0, 1, 2) for _ in range(20)], 1)
    b = boosting.fit(rows, rounds=1, rate=1.0)
    # a pure leaf of the class itself: (2/3) * (2/3) / (2/9) = 2; of another class: (2/3) * (-1/3) / (2/9) = -1
    codes = np.array([[sum(e < x for e in b.edges[0])] for x in (0.0, 1.0, 2.0)])
    assert boosting._added(codes, b, 0) == pytest.approx(np.where(np.eye(3) > 0, 2.0, -1.0))
    assert b.losses == [pytest.approx(np.log(3))] and boosting.importance(b) == [1.0]


def test_log_loss_falls_every_round_and_copies_count(spark):
    rng = np.random.default_rng(4)
    data = [(float(k) + 5, float(a + k), float(c), 7.0) for k, a, c in zip(rng.integers(0, 3, 600), rng.normal(size=600), rng.integers(0, 4, 600))]
    b = boosting.fit(_vectors(spark, data, 3), rounds=12, keep=5)
    assert len(b.losses) == 12 and all(x > y for x, y in zip(b.losses, b.losses[1:]))
    got = boosting.predict(b, _vectors(spark, data, 3)).toPandas()
    assert set(got["prediction"]) <= {5.0, 6.0, 7.0} and (got["label"] == got["prediction"]).mean() > 0.55
    assert np.stack(got["probability"]).sum(axis=1) == pytest.approx(1.0)
    thrice = boosting.fit(_vectors(spark, data * 3, 3), rounds=12, keep=4)
    assert thrice.losses == pytest.approx(b.losses) and boosting.importance(thrice) == pytest.approx(boosting.importance(b))
    assert boosting.importance(b)[2] == 0.0  # a constant feature


def test_boosting_refuses_no_rows_and_endless_classes(spark):
    with pytest.raises(ValueError):
        boosting.fit(_vectors(spark, [], 1))
    with pytest.raises(ValueError):
        boosting.fit(_vectors(spark, [(float(i), 0.0) for i in range(boosting.MAX_CLASSES + 1)], 1))


def test_feature_regression_picks_its_columns(spark):
    rows = [(float(2 * i + j), float(i), "t", float(j), float(-i)) for i in range(20) for j in range(3)]
    df = spark.createDataFrame(rows, "y double, a double, t string, b double, c double")
    metrics, imp, _ = ml.feature_regression(df, max_depth=4)
    assert {r["feature"] for r in imp.collect()} == {"a", "b"} and metrics.first()["r2"] > 0.5
    assert {r["feature"] for r in ml.feature_regression(df, "c", max_depth=2)[1].collect()} == {"y", "a"}
    for bad in (df.select("y", "t"), None):
        with pytest.raises(ValueError):
            ml.feature_regression(df, "y", ["y"]) if bad is None else ml.feature_regression(bad)
