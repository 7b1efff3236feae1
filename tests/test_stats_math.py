"""Special functions, hypothesis tests, distributed ranks and quantiles."""
import math

import numpy as np
import pandas as pd
import pytest

from tessera.functions.ranks import exact_quantiles, value_ranks
from tessera.functions.special import betainc, f_upper_p, t_two_sided_p
from tessera.operators import stats


def test_betainc_identities():
    for x in (0.1, 0.37, 0.8):
        assert betainc(1.0, 1.0, x) == pytest.approx(x, abs=1e-12)
        assert betainc(2.5, 3.5, x) == pytest.approx(1 - betainc(3.5, 2.5, 1 - x), abs=1e-12)
    # I_x(a, 1) = x^a
    assert betainc(3.0, 1.0, 0.6) == pytest.approx(0.6 ** 3, abs=1e-12)


def test_p_values_against_closed_forms():
    # t with 1 df is Cauchy: p = 1 - 2/pi * atan(|t|)
    assert t_two_sided_p(1.7, 1.0) == pytest.approx(1 - 2 / math.pi * math.atan(1.7), abs=1e-10)
    # large df -> normal
    assert t_two_sided_p(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    # F(2, d2 -> inf): p = exp(-F)
    assert f_upper_p(1.3, 2.0, 1e8) == pytest.approx(math.exp(-1.3), abs=1e-6)
    # F(d1, d2) with d1 = 2: p = (1 + 2F/d2)^(-d2/2)
    assert f_upper_p(3.0, 2.0, 10.0) == pytest.approx((1 + 2 * 3.0 / 10.0) ** -5, abs=1e-12)


def test_shapiro_behaviour():
    rng = np.random.default_rng(0)
    w, p = stats.shapiro_wilk(rng.normal(size=300))
    assert 0.98 < w <= 1.0 and p > 0.01
    w, p = stats.shapiro_wilk(rng.exponential(size=300))
    assert w < 0.95 and p < 1e-6
    w, p = stats.shapiro_wilk(np.array([1.0, 2.0, 4.0]))
    assert 0 < w <= 1 and 0 <= p <= 1


def test_group_tests_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in "abc" for v in rng.normal(loc={"a": 0, "b": 0.3, "c": 0.1}[g], size=50 + ord(g))]
    df = spark.createDataFrame(rows, "g string, x double")
    p = pd.DataFrame(rows, columns=["g", "x"])
    groups_ = [grp["x"].to_numpy() for _, grp in p.groupby("g")]
    n = sum(len(a) for a in groups_)
    gm = p["x"].mean()
    ssb = sum(len(a) * (a.mean() - gm) ** 2 for a in groups_)
    ssw = sum(((a - a.mean()) ** 2).sum() for a in groups_)
    f = (ssb / 2) / (ssw / (n - 3))
    r = stats.group_test(df, "g", "x").first()
    assert r["groups"] == 3 and r["statistic"] == round(f, 4) and r["df2"] == n - 3
    two = df.where("g != 'c'")
    a, b = groups_[0], groups_[1]
    sp2 = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    t = (a.mean() - b.mean()) / math.sqrt(sp2 * (1 / len(a) + 1 / len(b)))
    assert stats.group_test(two, "g", "x").first()["statistic"] == round(t, 4)
    one = df.where("g = 'a'")
    assert stats.group_test(one, "g", "x").first()["test_name"] == "N/A"


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 20, 400).astype(float)
    y = x + rng.normal(size=400) * 5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double")
    rho = stats.spearman_test(df, "a", "b").first()["rho"]
    want = pd.Series(x).rank().corr(pd.Series(y).rank())  # Spearman = Pearson of average ranks
    assert rho == round(want, 4)


def test_spearman_counts_equal_pairs(spark):
    rows = [(1.0, 2.0)] * 300 + [(float(i % 7), float((i * i) % 11)) for i in range(200)] + [(None, 1.0), (float("nan"), 2.0), (3.0, None)]
    got = stats.spearman_test(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    x = pd.DataFrame(rows, columns=["a", "b"]).dropna()
    assert got["n"] == len(x) == 500 and got["rho"] == round(x["a"].rank().corr(x["b"].rank()), 4)
    constant = stats.spearman_test(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()
    assert constant["rho"] is None and constant["n"] == 2
    none = stats.spearman_test(spark.createDataFrame([], "a double, b double"), "a", "b").first()
    assert none["rho"] is None and none["n"] == 0


def test_equal_totals_are_ranked_by_name(spark):
    from tessera.operators import segment
    rows = [(f"c{i:03d}", 0.0) for i in range(150)] + [("z", 5.0), ("y", 5.0), (None, 9.0), ("w", -1.0), ("v", None)]
    got = segment.category_performance(spark.createDataFrame(rows, "c string, x double"), "c", "x")
    ranks = {r["category"]: r["rank"] for r in got.collect()}
    assert ranks["y"] == 1 and ranks["z"] == 2 and ranks["c000"] == 3 and ranks["c149"] == 152 and ranks["v"] == 153 and ranks["w"] == 154


def test_kpi_dashboard_reads_its_input_once(spark):
    from tessera.operators import kpi
    rows = [("p1", "r1", 7, 10.0, -1.0, "2024-01-03"), ("p2", "r1", 7, 30.0, 2.0, "2024-02-03"), (None, "r2", None, 5.0, None, None), ("p1", None, 8, None, 1.0, "2024-02-01")]
    schema = "product string, region string, customer_id long, sales double, profit double, order_date string"
    got = {r["name"]: (r["value"], r["formatted"]) for r in kpi.kpi_dashboard(spark.createDataFrame(rows, schema)).collect()}
    assert got["Total Revenue"][0] == 45.0 and got["Average Order Value"][0] == 15.0 and got["Unique Customers"][0] == 2
    assert got["Top Product"][1] == "p2" and got["Top Region"][1] == "r1" and got["MoM Growth"][0] == 200.0 and got["Best Month"][1] == "2024-02"
    assert got["Loss Transactions"] == (1.0, "1") and "Total Quantity" not in got and "Top Category" not in got
    empty = {r["name"]: r["value"] for r in kpi.kpi_dashboard(spark.createDataFrame([], schema)).collect()}
    assert empty["Total Revenue"] == 0.0 and empty["Average Order Value"] is None and empty["Unique Customers"] == 0
    assert kpi.kpi_dashboard(spark.createDataFrame([("a",)], "note string")).count() == 0
    d = spark.createDataFrame(rows, schema)
    plan = kpi._summary(d, kpi.detect(d), "product", "region", "customer", "month")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("Aggregate") == 1


def test_value_ranks_average(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 50, 2000)
    df = spark.createDataFrame([(int(v),) for v in x], "v long")
    got = {r["v"]: r["rank_avg"] for r in value_ranks(df).collect()}
    want = pd.Series(x).rank(method="average")
    for v, rk in zip(x, want):
        assert got[int(v)] == rk


def test_exact_quantiles(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=1001), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    q = exact_quantiles(df, "v", [0.0, 0.05, 0.5, 0.95, 1.0]).first()
    for i, p in enumerate([0.0, 0.05, 0.5, 0.95, 1.0]):
        assert q[f"q{i}"] == pytest.approx(np.percentile(x, p * 100), abs=1e-12)


@pytest.mark.parametrize("runs", [1, 3, 50])
def test_grouped_quantiles_for_any_number_of_runs(spark, runs):
    from tessera.functions.colstats import grouped_quantiles, long_counts
    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=3000), 2)
    y = rng.integers(0, 7, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", runs)
    try:
        found = {r["column_name"]: r for r in grouped_quantiles(long_counts(df, ["a", "b"]), [0.1, 0.5, 0.9]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for name, arr in (("a", x), ("b", y)):
        for i, p in enumerate([0.1, 0.5, 0.9]):
            assert found[name][f"q{i}"] == pytest.approx(np.percentile(arr, p * 100), abs=1e-12)


def test_no_run_holds_much_more_than_its_share(spark):
    from tessera.functions.ranks import with_runs
    counts = spark.range(20_000).selectExpr("id * id AS v", "1 AS cnt")
    runs = {r["_run"]: r["count"] for r in with_runs(counts, [], "v").groupBy("_run").count().collect()}
    assert len(runs) >= 6 and max(runs.values()) <= 2.5 * 20_000 / 8


def test_constant_groups_have_no_statistic(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    assert stats.group_test(df, "g", "x").first()["statistic"] is None
    three = df.union(spark.createDataFrame([("c", 3.0), ("c", 3.0)], "g string, x double"))
    assert stats.group_test(three, "g", "x").first()["statistic"] is None


def test_sketched_quantiles_are_near(spark):
    from tessera.functions.colstats import quantile_row
    df = spark.range(50_001).selectExpr("cast(id AS double) AS v", "cast(NULL AS double) AS w")
    r = quantile_row(df, ["v", "w"], [0.25, 0.5], approx=True).first()
    assert abs(r["q0_0"] - 12_500) <= 50 and abs(r["q0_1"] - 25_000) <= 50 and r["q1_0"] is None
