"""Plan-shape assertions: pruning, pushdown, partial aggregation, bounded
exchanges, broadcast of the fixed-size dimensions."""
from pyspark.sql import functions as F

from tessera.operators import eda, groups, profile
from tessera.plans.views import sales, table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_pruning_and_pushdown(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    p = _plan(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_partial_aggregation_before_shuffle(spark, sf):
    p = _plan(groups.group_agg(sales(spark, sf), "category", "sales"))
    assert "partial_sum" in p


def test_fixed_dimensions_broadcast(spark, sf):
    p = sales(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in p


def test_univariate_exchange_count(spark, sf):
    # wide aggregate + outlier pass + mode long form: a bounded number of shuffles for any column count
    u = eda.univariate(table(spark, sf, "lineitem"))
    u.collect()
    p = u._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert p.count("Exchange") <= 12


def test_categorical_summary_one_long_shuffle(spark, sf):
    c = eda.categorical_summary(table(spark, sf, "part"))
    c.collect()
    p = c._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # all text columns exploded once and scanned once (the second branch reuses the exchange)
    assert p.count("FileScan parquet") == 1 and "ReusedExchange" in p


def test_corr_matrix_pairwise_complete(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    x[:, 1] += x[:, 0]
    x[rng.random(400) < 0.1, 0] = np.nan
    x[rng.random(400) < 0.2, 2] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (1.0,) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(r["col1"], r["col2"]): r["correlation"] for r in eda.corr_matrix(df).collect()}
    want = pd.DataFrame(x, columns=["a", "b", "c"]).corr()
    for i in "abc":
        for j in "abc":
            assert got[(i, j)] == round(want.loc[i, j], 4)
        assert got[(i, "k")] is None  # constant column: NULL, not an error


def test_distinct_counts_no_expand(spark, sf):
    d = profile.distinct_counts(table(spark, sf, "customer"))
    p = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in p


def test_headline_query_prunes_every_scan(spark, sf):
    from tessera.operators import forecast
    m = forecast.monthly_totals(sales(spark, sf), "order_date", "sales")
    m.collect()
    p = m._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    schemas = [line.split("ReadSchema: ")[1] for line in p.split("\n") if "ReadSchema: " in line]
    assert schemas, p
    # lineitem is read for the join keys and the measure only, never all 11 columns
    li = [s for s in schemas if "l_orderkey" in s]
    assert li and all("l_shipdate" not in s and "l_returnflag" not in s for s in li)
    # the date / value NULL filter reaches the scans as pushed filters
    assert "PushedFilters: [IsNotNull(o_orderdate)" in p


def test_dirty_sales_read_each_table_once(spark, sf):
    from tessera.plans.views import sales, sales_dirty
    dirty = sales_dirty(spark, sf)
    plan = dirty._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.lower().count("union") == 0
    clean = sales(spark, sf)
    assert dirty.count() == clean.count() + clean.where("order_id % 23 = 0").count()
    assert dirty.where("order_id % 23 = 0").groupBy(*dirty.columns).count().where("count % 2 = 1").isEmpty()


def test_a_group_of_quantiles_is_not_dealt_to_one_task(spark):
    """What is dealt out by the group alone are partial results (a row per group and task), never the positions."""
    import re

    from tessera.functions.colstats import grouped_quantiles
    counts = spark.range(5_000).select(F.lit("a").alias("column_name"), F.col("id").cast("double").alias("value"), F.lit(1).cast("long").alias("cnt"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a table of any size
    try:
        q = grouped_quantiles(counts, [0.25, 0.5])
        assert q.first().asDict() == {"column_name": "a", "q0": 1249.75, "q1": 2499.5}
        p = _plan(q)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"Join \[column_name#\d+\]", p)
