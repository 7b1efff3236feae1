"""Trend and forecast queries on the ``sales`` fixture."""

from __future__ import annotations

from tessera.operators import forecast as fc
from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.views import sales, sales_dirty, with_dirty, with_sales

_M = """m AS (SELECT strftime(order_date, '%Y-%m') AS period, SUM(sales) AS value
           FROM sales WHERE order_date IS NOT NULL AND sales IS NOT NULL GROUP BY 1),
i AS (SELECT period, value, CAST(ROW_NUMBER() OVER (ORDER BY period) - 1 AS BIGINT) AS idx FROM m)"""

_M_BY = """m AS (SELECT region, strftime(order_date, '%Y-%m') AS period, SUM(sales) AS value
           FROM sales WHERE order_date IS NOT NULL AND sales IS NOT NULL AND region IS NOT NULL
           GROUP BY 1, 2),
i AS (SELECT region, period, value,
             CAST(ROW_NUMBER() OVER (PARTITION BY region ORDER BY period) - 1 AS BIGINT) AS idx FROM m)"""


@register("monthly_trend")
def monthly_trend(spark, d):
    from pyspark.sql import functions as F
    return fc.monthly_totals(sales(spark, d), "order_date", "sales").select(
        "period", F.round("value", 2).alias("value"))


oracle("monthly_trend", with_sales(f""", {_M}
SELECT period, ROUND(value, 2) AS value FROM m"""))


@register("monthly_indexed")
def monthly_indexed(spark, d):
    from pyspark.sql import functions as F
    return fc.monthly_indexed(sales(spark, d), "order_date", "sales").select(
        "period", "idx", F.round("value", 2).alias("value"))


oracle("monthly_indexed", with_sales(f""", {_M}
SELECT period, idx, ROUND(value, 2) AS value FROM i"""))


_LIN = """f AS (SELECT regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a,
                MAX(idx) AS last_idx, AVG(value) AS ybar FROM i),
r AS (SELECT i.*, a + b * idx AS pred, f.ybar, f.a, f.b, f.last_idx FROM i, f),
s AS (SELECT STDDEV_POP(value - pred) AS sd,
             ROUND(AVG(ABS(value - pred)), 2) AS mae,
             ROUND(SQRT(AVG((value - pred) * (value - pred))), 2) AS rmse,
             ROUND(1 - SUM((value - pred) * (value - pred)) / SUM((value - ybar) * (value - ybar)), 4) AS r2,
             ANY_VALUE(a) AS a, ANY_VALUE(b) AS b, ANY_VALUE(last_idx) AS last_idx FROM r)"""


@register("forecast_linear")
def forecast_linear(spark, d):
    return fc.forecast_linear(sales(spark, d), "order_date", "sales", periods=3)


oracle("forecast_linear", with_sales(f""", {_M}, {_LIN}
SELECT CAST(step AS BIGINT) AS step, 'Month +' || CAST(step AS VARCHAR) AS period,
       ROUND(a + b * (last_idx + step), 2) AS forecast,
       ROUND(a + b * (last_idx + step) - 1.96 * sd, 2) AS lower,
       ROUND(a + b * (last_idx + step) + 1.96 * sd, 2) AS upper
FROM s, (SELECT UNNEST(range(1, 4)) AS step) t"""))


@register("forecast_metrics")
def forecast_metrics(spark, d):
    return fc.forecast_linear_metrics(sales(spark, d), "order_date", "sales")


oracle("forecast_metrics", with_sales(f""", {_M}, {_LIN}
SELECT 'Linear Trend' AS method, mae, rmse, r2 FROM s"""))


@register("forecast_linear_by_region")
def forecast_linear_by_region(spark, d):
    return fc.forecast_linear(sales(spark, d), "order_date", "sales", periods=3, by=["region"])


oracle("forecast_linear_by_region", with_sales(f""", {_M_BY},
f AS (SELECT region, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a,
             MAX(idx) AS last_idx FROM i GROUP BY region),
s AS (SELECT f.region, ANY_VALUE(a) AS a, ANY_VALUE(b) AS b, ANY_VALUE(last_idx) AS last_idx,
             STDDEV_POP(value - (a + b * idx)) AS sd
      FROM i JOIN f ON i.region = f.region GROUP BY f.region)
SELECT region, CAST(step AS BIGINT) AS step, 'Month +' || CAST(step AS VARCHAR) AS period,
       ROUND(a + b * (last_idx + step), 2) AS forecast,
       ROUND(a + b * (last_idx + step) - 1.96 * sd, 2) AS lower,
       ROUND(a + b * (last_idx + step) + 1.96 * sd, 2) AS upper
FROM s, (SELECT UNNEST(range(1, 4)) AS step) t"""))


_MA = """n AS (SELECT COUNT(*) AS n FROM i),
w AS (SELECT i.*, n.n,
        COUNT(value) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c,
        AVG(value) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a,
        FIRST_VALUE(value) OVER (ORDER BY idx) AS fv,
        AVG(value) OVER () AS ybar
      FROM i, n),
p AS (SELECT *, CASE WHEN c >= LEAST(3, n) THEN a END AS ma,
             COALESCE(CASE WHEN c >= LEAST(3, n) THEN a END, fv) AS pred FROM w)"""


@register("moving_average")
def moving_average(spark, d):
    return fc.moving_average(sales(spark, d), "order_date", "sales", window=3)


oracle("moving_average", with_sales(f""", {_M}, {_MA}
SELECT period, idx, ROUND(value, 2) AS value, ROUND(ma, 4) AS ma, ROUND(pred, 4) AS fitted FROM p"""))


@register("forecast_ma")
def forecast_ma(spark, d):
    return fc.forecast_ma(sales(spark, d), "order_date", "sales", periods=3, window=3)


oracle("forecast_ma", with_sales(f""", {_M},
t AS (SELECT AVG(value) AS m, STDDEV_SAMP(value) AS s
      FROM (SELECT value FROM i ORDER BY idx DESC LIMIT 3))
SELECT CAST(step AS BIGINT) AS step, 'Month +' || CAST(step AS VARCHAR) AS period,
       ROUND(m, 2) AS forecast, ROUND(m - 1.96 * s, 2) AS lower, ROUND(m + 1.96 * s, 2) AS upper
FROM t, (SELECT UNNEST(range(1, 4)) AS step) x"""))


@register("forecast_ma_metrics")
def forecast_ma_metrics(spark, d):
    return fc.forecast_ma_metrics(sales(spark, d), "order_date", "sales", window=3)


oracle("forecast_ma_metrics", with_sales(f""", {_M}, {_MA}
SELECT 'Moving Average' AS method,
       ROUND(AVG(ABS(value - pred)), 2) AS mae,
       ROUND(SQRT(AVG((value - pred) * (value - pred))), 2) AS rmse,
       ROUND(1 - SUM((value - pred) * (value - pred)) / SUM((value - ybar) * (value - ybar)), 4) AS r2
FROM p"""))


@register("history_forecast_union")
def history_forecast_union(spark, d):
    return fc.history_forecast_union(sales(spark, d), "order_date", "sales", periods=3)


oracle("history_forecast_union", with_sales(f""", {_M}, {_LIN}
SELECT period, ROUND(value, 2) AS value, 'History' AS kind FROM m
UNION ALL
SELECT 'Month +' || CAST(step AS VARCHAR) AS period, ROUND(a + b * (last_idx + step), 2) AS value,
       'Forecast' AS kind
FROM s, (SELECT UNNEST(range(1, 4)) AS step) t"""))


@register("forecast_linear_24")
def forecast_linear_24(spark, d):
    return fc.forecast_linear(sales(spark, d), "order_date", "sales", periods=24)


oracle("forecast_linear_24", with_sales(f""", {_M}, {_LIN}
SELECT CAST(step AS BIGINT) AS step, 'Month +' || CAST(step AS VARCHAR) AS period,
       ROUND(a + b * (last_idx + step), 2) AS forecast,
       ROUND(a + b * (last_idx + step) - 1.96 * sd, 2) AS lower,
       ROUND(a + b * (last_idx + step) + 1.96 * sd, 2) AS upper
FROM s, (SELECT UNNEST(range(1, 25)) AS step) x"""))


@register("monthly_trend_text")
def monthly_trend_text(spark, d):
    """Dates given as text, some of which do not parse."""
    from pyspark.sql import functions as F
    return fc.monthly_totals(sales_dirty(spark, d), "order_date_text", "quantity").select(
        "period", F.round("value", 2).alias("value"))


oracle("monthly_trend_text", with_dirty("""
SELECT strftime(TRY_STRPTIME(order_date_text, '%Y-%m-%d'), '%Y-%m') AS period, ROUND(SUM(quantity), 2) AS value
FROM sales_dirty WHERE TRY_STRPTIME(order_date_text, '%Y-%m-%d') IS NOT NULL AND quantity IS NOT NULL GROUP BY 1"""))
