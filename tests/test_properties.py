"""Property tests: idempotence, partitions of the data, invariance under
repartitioning."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import clean, groups, ml, segment
from tessera.plans.views import sales, sales_dirty, table


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedupe_idempotent(spark, sf):
    d = clean.drop_duplicates(sales_dirty(spark, sf))
    assert _rows(clean.drop_duplicates(d)) == _rows(d)


def test_clean_twice_is_clean_once(spark, sf):
    once, _ = clean.clean(sales_dirty(spark, sf))
    twice, _ = clean.clean(once)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(once.collect(), key=key) == sorted(twice.collect(), key=key)


def test_shares_sum_to_100(spark, sf):
    s = groups.share_of_total(sales(spark, sf), "category", "sales", None)
    assert abs(sum(r["share_pct"] for r in s.collect()) - 100.0) < 1e-3  # shares are rounded to 4 dp


def test_segments_partition_customers(spark, sf):
    o = table(spark, sf, "orders")
    seg = segment.rfm_segments(o, "o_custkey", "o_orderdate", "o_totalprice")
    n_cust = o.select("o_custkey").distinct().count()
    assert sum(r["customers"] for r in seg.collect()) == n_cust


def test_results_stable_under_repartition(spark, sf):
    s = sales(spark, sf)
    a = _rows(groups.compare(s, "region", "profit"))
    b = _rows(groups.compare(s.repartition(13), "region", "profit"))
    assert a == b
    h1 = ml.hash_split(table(spark, sf, "orders")).where("is_test").count()
    h2 = ml.hash_split(table(spark, sf, "orders").repartition(7)).where("is_test").count()
    assert h1 == h2


def test_chrono_split_sizes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    n = o.count()
    s = ml.chrono_split(o, "o_orderdate")
    test = s.where("is_test")
    import math
    assert test.count() == math.ceil(0.2 * n)
    assert test.agg(F.min("o_orderdate")).first()[0] >= s.where(~F.col("is_test")).agg(F.max("o_orderdate")).first()[0]


def test_category_ranks_are_dense(spark, sf):
    rows = _rows(segment.category_performance(sales(spark, sf), "product", "sales"))
    assert [r[0] for r in sorted(rows)] == list(range(1, len(rows) + 1))


def test_zero_total_has_no_share(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "c string, v double")
    assert [r["share_pct"] for r in segment.category_performance(df, "c", "v").collect()] == [None, None]


def test_chrono_split_with_equal_and_missing_times(spark):
    import datetime
    day = datetime.datetime(2024, 1, 1)
    same = spark.createDataFrame([(1, day)] * 10, "k int, t timestamp")
    assert sorted(r.is_test for r in ml.chrono_split(same, "t").collect()) == [False] * 8 + [True] * 2
    rows = [(i, None if i < 3 else day + datetime.timedelta(days=i)) for i in range(10)]
    out = ml.chrono_split(spark.createDataFrame(rows, "k int, t timestamp"), "t").collect()
    assert sorted(r.k for r in out) == list(range(10)) and {r.k for r in out if r.is_test} == {8, 9}
    assert ml.chrono_split(spark.createDataFrame([], "k int, t timestamp"), "t").collect() == []


def test_limits_are_the_callers(spark):
    from tessera.operators import eda, forecast
    df = spark.range(60).selectExpr("concat('k', id) AS c", "cast(id AS double) AS v")
    assert groups.top_n(df, "c", "v", 40).count() == 40
    assert eda.histogram(df, "v", 3).count() == 3
    with pytest.raises(ValueError):
        groups.top_n(df, "c", "v", 0)
    with pytest.raises(ValueError):
        forecast.forecast_linear(df, "c", "v", 0)


def test_text_dates_that_do_not_parse_are_left_out(spark):
    from tessera.operators import forecast, kpi
    df = spark.createDataFrame([("a", "2024-01-05", 1.0), ("a", "no date", 5.0), ("b", "2024-02-01", 2.0)], "c string, d string, v double")
    assert {r["period"]: r["value"] for r in forecast.monthly_totals(df, "d", "v").collect()} == {"2024-01": 1.0, "2024-02": 2.0}
    assert {r["period"]: r["value"] for r in kpi.monthly_sums(df, "d", "v").collect()} == {"2024-01": 1.0, "2024-02": 2.0}
    assert {r["customer"]: r["recency"] for r in segment.rfm_metrics(df, "c", "d", "v").collect()} == {"a": 27, "b": 0}


def test_univariate_of_too_few_values(spark):
    from tessera.operators import eda
    r = eda.univariate(spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")).collect()
    assert (r[0]["skewness"], r[0]["kurtosis"], r[0]["mean"]) == (None, None, 1.5) and r[1]["mean"] == 0.0


def test_detect_unknown_method_is_iqr(spark, sf):
    from tessera.operators import anomaly
    ev = table(spark, sf, "events")
    a = anomaly.detect(ev, ["value"], "no-such-method")[0].first()
    b = anomaly.detect(ev, ["value"], "iqr")[0].first()
    assert a["method"] == "IQR" and a == b


def test_ask_dispatches_to_named_operator(spark, sf):
    from tessera.operators import questions
    s = sales(spark, sf)
    top = questions.ask(s, "Top 3 region by profit")
    assert top.columns == ["region", "value"] and top.count() == 3
    assert _rows(top) == _rows(groups.top_n(s, "region", "profit", 3))
    assert questions.ask(s, "compare sales by category").columns == ["category", "sum", "mean", "count"]
