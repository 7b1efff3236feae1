"""Grouped / top-k / comparison queries."""

from __future__ import annotations

from tessera.operators import groups as g
from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.views import sales, table, with_sales


@register("group_sum")
def group_sum(spark, d):
    return g.group_agg(sales(spark, d), "category", "sales", "sum")


oracle("group_sum", with_sales("""
SELECT category, ROUND(COALESCE(SUM(sales), 0.0), 4) AS value FROM sales
WHERE category IS NOT NULL GROUP BY category"""))


@register("group_mean")
def group_mean(spark, d):
    return g.group_agg(sales(spark, d), "region", "profit", "mean")


oracle("group_mean", with_sales("""
SELECT region, ROUND(AVG(profit), 4) AS value FROM sales WHERE region IS NOT NULL GROUP BY region"""))


@register("group_count")
def group_count(spark, d):
    return g.group_agg(sales(spark, d), "product", "quantity", "count")


oracle("group_count", with_sales("""
SELECT product, ROUND(CAST(COUNT(quantity) AS DOUBLE), 4) AS value FROM sales
WHERE product IS NOT NULL GROUP BY product"""))


@register("compare_categories")
def compare_categories(spark, d):
    return g.compare(sales(spark, d), "region", "profit")


oracle("compare_categories", with_sales("""
SELECT region, ROUND(COALESCE(SUM(profit), 0.0), 2) AS sum, ROUND(AVG(profit), 2) AS mean,
       CAST(COUNT(profit) AS BIGINT) AS count
FROM sales WHERE region IS NOT NULL GROUP BY region"""))


@register("top_n")
def top_n(spark, d):
    return g.top_n(sales(spark, d), "product", "sales", 5)


oracle("top_n", with_sales("""
SELECT product, ROUND(value, 2) AS value FROM (
  SELECT product, COALESCE(SUM(sales), 0.0) AS value FROM sales
  WHERE product IS NOT NULL GROUP BY product)
ORDER BY value DESC, product LIMIT 5"""))


@register("bottom_n")
def bottom_n(spark, d):
    return g.bottom_n(sales(spark, d), "product", "profit", 5)


oracle("bottom_n", with_sales("""
SELECT product, ROUND(value, 2) AS value FROM (
  SELECT product, COALESCE(SUM(profit), 0.0) AS value FROM sales
  WHERE product IS NOT NULL GROUP BY product)
ORDER BY value ASC, product LIMIT 5"""))


@register("top_rows")
def top_rows(spark, d):
    return g.top_rows(sales(spark, d), "sales", 10)


oracle("top_rows", with_sales("""
SELECT * FROM sales
ORDER BY sales DESC NULLS LAST, order_id, line_no, order_date, customer_id, product, category, region, quantity, profit, discount
LIMIT 10"""))


@register("top_rows_six")
def top_rows_six(spark, d):
    return g.top_rows(sales(spark, d), "sales", 10, max_cols=6)


oracle("top_rows_six", with_sales("""
SELECT order_id, line_no, order_date, customer_id, product, category, sales FROM sales
ORDER BY sales DESC NULLS LAST, order_id, line_no, order_date, customer_id, product, category
LIMIT 10"""))


@register("best_by")
def best_by(spark, d):
    return g.best_by(sales(spark, d), "region", "sales")


oracle("best_by", with_sales("""
SELECT region AS best, ROUND(value, 2) AS value FROM (
  SELECT region, COALESCE(SUM(sales), 0.0) AS value FROM sales
  WHERE region IS NOT NULL GROUP BY region)
ORDER BY value DESC, region LIMIT 1"""))


@register("share_of_total")
def share_of_total(spark, d):
    return g.share_of_total(sales(spark, d), "category", "sales", 6)


oracle("share_of_total", with_sales("""
, s AS (SELECT category, COALESCE(SUM(sales), 0.0) AS value FROM sales
        WHERE category IS NOT NULL GROUP BY category),
t AS (SELECT SUM(value) AS total FROM s)
SELECT category, ROUND(value, 2) AS value, ROUND(value * 100 / total, 4) AS share_pct
FROM (SELECT * FROM s ORDER BY value DESC, category LIMIT 6), t"""))


@register("value_counts")
def value_counts(spark, d):
    return g.value_counts(table(spark, d, "events"), "event_type")


oracle("value_counts", """
SELECT CAST(event_type AS VARCHAR) AS value, CAST(COUNT(*) AS BIGINT) AS count,
       ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM events), 4) AS pct
FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")


@register("value_counts_pct")
def value_counts_pct(spark, d):
    return g.value_counts(table(spark, d, "orders"), "o_orderpriority", n=3)


oracle("value_counts_pct", """
SELECT value, count, pct FROM (
  SELECT CAST(o_orderpriority AS VARCHAR) AS value, CAST(COUNT(*) AS BIGINT) AS count,
         ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM orders), 4) AS pct
  FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)
ORDER BY count DESC, value LIMIT 3""")


@register("total")
def total(spark, d):
    return g.totals(sales(spark, d), "sales")


oracle("total", with_sales("""
SELECT ROUND(COALESCE(SUM(sales), 0.0), 2) AS total, ROUND(AVG(sales), 2) AS average,
       CAST(COUNT(*) AS BIGINT) AS count FROM sales"""))


@register("average")
def average(spark, d):
    return g.average(sales(spark, d), "profit")


oracle("average", with_sales("""
SELECT ROUND(AVG(profit), 2) AS mean, ROUND(QUANTILE_CONT(profit, 0.5), 2) AS median,
       ROUND(STDDEV_SAMP(profit), 2) AS std FROM sales"""))


@register("average_by")
def average_by(spark, d):
    return g.average_by(sales(spark, d), "profit", "region")


oracle("average_by", with_sales("""
SELECT region, ROUND(AVG(profit), 2) AS mean FROM sales WHERE region IS NOT NULL GROUP BY region"""))


@register("preview")
def preview(spark, d):
    return g.preview(table(spark, d, "orders"), 100)


oracle("preview", """
SELECT * FROM orders
ORDER BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority LIMIT 100""")


@register("column_stats")
def column_stats(spark, d):
    return g.numeric_summary(table(spark, d, "lineitem"), "l_extendedprice")


oracle("column_stats", """
SELECT ROUND(AVG(l_extendedprice), 2) AS mean, ROUND(QUANTILE_CONT(l_extendedprice, 0.5), 2) AS median,
       ROUND(STDDEV_SAMP(l_extendedprice), 2) AS std, ROUND(MIN(l_extendedprice), 2) AS min,
       ROUND(MAX(l_extendedprice), 2) AS max, ROUND(COALESCE(SUM(l_extendedprice), 0.0), 2) AS sum
FROM lineitem""")


@register("column_stats_text")
def column_stats_text(spark, d):
    return g.categorical_answer(table(spark, d, "customer"), "c_mktsegment", 5)


oracle("column_stats_text", """
WITH c AS (SELECT c_mktsegment AS value, COUNT(*) AS count FROM customer
           WHERE c_mktsegment IS NOT NULL GROUP BY 1),
s AS (SELECT CAST(COUNT(*) AS BIGINT) AS "unique",
             (SELECT value FROM c ORDER BY count DESC, value LIMIT 1) AS mode FROM c)
SELECT s."unique", s.mode, CAST(value AS VARCHAR) AS value, CAST(count AS BIGINT) AS count
FROM (SELECT * FROM c ORDER BY count DESC, value LIMIT 5), s""")


@register("scatter_bins")
def scatter_bins(spark, d):
    return g.scatter_bins(table(spark, d, "part"), "p_size", "p_retailprice", "p_brand", bins=40)


oracle("scatter_bins", """
WITH r AS (SELECT MIN(p_size)::DOUBLE AS xl, MAX(p_size)::DOUBLE AS xh, MIN(p_retailprice) AS yl, MAX(p_retailprice) AS yh
           FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL)
SELECT CAST(LEAST(FLOOR(COALESCE((p_size - xl) / NULLIF(xh - xl, 0), 0) * 40), 39) AS BIGINT) AS x_bin,
       CAST(LEAST(FLOOR(COALESCE((p_retailprice - yl) / NULLIF(yh - yl, 0), 0) * 40), 39) AS BIGINT) AS y_bin,
       p_brand, CAST(COUNT(*) AS BIGINT) AS count
FROM part, r WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY 1, 2, 3""")


@register("top_n_wide")
def top_n_wide(spark, d):
    return g.top_n(table(spark, d, "orders"), "o_custkey", "o_totalprice", 40)


oracle("top_n_wide", """
SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS value FROM orders WHERE o_custkey IS NOT NULL
GROUP BY 1 ORDER BY SUM(o_totalprice) DESC, o_custkey LIMIT 40""")
