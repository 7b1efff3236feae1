"""KPI and segmentation queries."""

from __future__ import annotations

from tessera.operators import kpi, segment as seg
from pyspark.sql import functions as F

from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.views import sales, sales_dirty, table, with_dirty, with_sales

_AGG = """a AS (SELECT COALESCE(SUM(sales), 0.0) AS tot, AVG(sales) AS avg, COALESCE(SUM(quantity), 0.0) AS qty,
               COALESCE(SUM(profit), 0.0) AS p, COUNT(*) FILTER (WHERE profit < 0) AS neg, COUNT(*) AS n,
               COUNT(DISTINCT customer_id) AS u FROM sales)"""


def _r(ord_, name, value, formatted, cat, context="''", where=None):
    w = f" WHERE {where}" if where else ""
    return (f"SELECT CAST({ord_} AS BIGINT) AS ord, '{name}' AS name, ROUND(CAST({value} AS DOUBLE), 4) AS value, "
            f"{formatted} AS formatted, '{cat}' AS category, {context} AS context FROM a{w}")


_REV = [_r(1, "Total Revenue", "tot", "'₹' || format('{:,.0f}', tot)", "revenue"),
        _r(2, "Average Order Value", "avg", "'₹' || format('{:,.0f}', avg)", "revenue"),
        _r(3, "Revenue Per Unit", "CASE WHEN qty > 0 THEN tot / qty ELSE 0.0 END",
           "'₹' || format('{:,.0f}', CASE WHEN qty > 0 THEN tot / qty ELSE 0.0 END)", "revenue")]
_PRO = [_r(4, "Total Profit", "p", "'₹' || format('{:,.0f}', p)", "profit"),
        _r(5, "Profit Margin", "p / tot * 100", "format('{:.1f}', p / tot * 100) || '%'", "profit", where="tot > 0"),
        _r(6, "Loss Transactions", "neg", "CAST(neg AS VARCHAR)", "profit",
           "format('{:.1f}', neg * 100.0 / n) || '% of transactions'", where="neg > 0")]
_VOL = [_r(7, "Total Quantity", "qty", "format('{:,.0f}', qty)", "volume")]
_CUS = [_r(8, "Unique Customers", "u", "format('{:,.0f}', CAST(u AS DOUBLE))", "customer"),
        _r(9, "Avg Spend/Customer", "CASE WHEN u > 0 THEN tot / u ELSE 0.0 END",
           "'₹' || format('{:,.0f}', CASE WHEN u > 0 THEN tot / u ELSE 0.0 END)", "customer")]


def _top(ord_, name, key):
    return (f"SELECT CAST({ord_} AS BIGINT) AS ord, '{name}' AS name, 0.0 AS value, CAST(k AS VARCHAR) AS formatted, "
            f"'performance' AS category, '' AS context FROM (SELECT {key} AS k, COALESCE(SUM(sales), 0.0) AS s "
            f"FROM sales WHERE {key} IS NOT NULL GROUP BY 1 ORDER BY s DESC, k LIMIT 1)")


_TOPS = [_top(10, "Top Product", "product"), _top(11, "Top Region", "region"), _top(12, "Top Category", "category")]
_M = """m AS (SELECT strftime(order_date, '%Y-%m') AS period, COALESCE(SUM(sales), 0.0) AS value FROM sales
              WHERE order_date IS NOT NULL GROUP BY 1),
l2 AS (SELECT * FROM m ORDER BY period DESC LIMIT 2),
t AS (SELECT MAX(period) AS last_period, arg_max(value, period) AS last, arg_min(value, period) AS prev,
             COUNT(*) AS n FROM l2)"""
_TIME = ["""SELECT CAST(13 AS BIGINT) AS ord, 'MoM Growth' AS name, ROUND((last - prev) / prev * 100, 4) AS value,
       format('{:+.1f}', (last - prev) / prev * 100) || '%' AS formatted, 'time' AS category, '' AS context
FROM t WHERE n >= 2 AND prev > 0""",
         """SELECT CAST(14 AS BIGINT), 'Best Month', ROUND(value, 4), period, 'time', ''
FROM (SELECT * FROM m ORDER BY value DESC, period LIMIT 1)"""]


def _kq(parts):
    return with_sales(f", {_AGG}, {_M}\n" + "\nUNION ALL\n".join(parts))


for key, fn, parts in (("kpi_revenue", kpi.kpi_revenue, _REV), ("kpi_profit", kpi.kpi_profit, _PRO),
                       ("kpi_volume", kpi.kpi_volume, _VOL), ("kpi_customer", kpi.kpi_customer, _CUS),
                       ("kpi_top_performers", kpi.kpi_top_performers, _TOPS), ("kpi_time", kpi.kpi_time, _TIME),
                       ("kpi_dashboard", kpi.kpi_dashboard, _REV + _PRO + _VOL + _CUS + _TOPS + _TIME)):
    register(key)(lambda spark, d, _f=fn: _f(sales(spark, d)))
    oracle(key, _kq(parts))


@register("mom_growth")
def mom_growth(spark, d):
    return kpi.mom_growth(sales(spark, d), "order_date", "sales")


oracle("mom_growth", with_sales(f""", {_M}
SELECT last_period, ROUND(last, 2) AS last_value, ROUND(CASE WHEN n >= 2 THEN prev END, 2) AS previous_value,
       ROUND(CASE WHEN n >= 2 AND prev > 0 THEN (last - prev) / prev * 100 END, 4) AS growth_pct FROM t"""))


@register("loss_transactions")
def loss_transactions(spark, d):
    return kpi.loss_transactions(sales(spark, d), "profit")


oracle("loss_transactions", with_sales("""
SELECT CAST(COUNT(*) FILTER (WHERE profit < 0) AS BIGINT) AS loss_count,
       ROUND(COUNT(*) FILTER (WHERE profit < 0) * 100.0 / COUNT(*), 2) AS loss_pct FROM sales"""))

# ---------------------------------------------------------------- segmentation
_SEG_VALUES = ", ".join(f"({r}, {f}, {m}, '{name}')" for (r, f, m), name in seg.RFM_SEGMENTS.items())
_RFM = f"""d AS (SELECT o_custkey AS customer, o_orderdate AS dt, o_totalprice AS v FROM orders
           WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
mx AS (SELECT MAX(dt) AS mx FROM d),
per AS (SELECT customer, CAST(FLOOR((epoch_us(ANY_VALUE(mx.mx)) - epoch_us(MAX(dt))) / 86400000000) AS BIGINT)
               AS recency, CAST(COUNT(*) AS BIGINT) AS frequency, SUM(v) AS monetary FROM d, mx GROUP BY customer),
e AS (SELECT QUANTILE_CONT(CAST(recency AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS er,
             QUANTILE_CONT(CAST(frequency AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS ef,
             QUANTILE_CONT(monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS em FROM per),
s AS (SELECT per.*, {{R}} AS r_score, {{F}} AS f_score, {{M}} AS m_score FROM per, e),
segs AS (SELECT * FROM (VALUES {_SEG_VALUES}) AS v(r_score, f_score, m_score, segment)),
rfm AS (SELECT customer, recency, frequency, ROUND(monetary, 2) AS monetary, s.r_score, s.f_score, s.m_score,
               COALESCE(segs.segment, 'Other') AS segment
        FROM s LEFT JOIN segs ON s.r_score = segs.r_score AND s.f_score = segs.f_score AND s.m_score = segs.m_score)"""


def _score_sql(x, e, reverse):
    strict = f"{e}[1] < {e}[2] AND {e}[2] < {e}[3] AND {e}[3] < {e}[4] AND {e}[4] < {e}[5] AND {e}[5] < {e}[6]"
    b = (f"CASE WHEN {x} <= {e}[2] THEN 1 WHEN {x} <= {e}[3] THEN 2 WHEN {x} <= {e}[4] THEN 3 "
         f"WHEN {x} <= {e}[5] THEN 4 ELSE 5 END")
    s = f"(6 - {b})" if reverse else b
    return f"CAST(CASE WHEN {strict} THEN {s} ELSE 3 END AS INTEGER)"


_RFM = (_RFM.replace("{R}", _score_sql("recency", "er", True)).replace("{F}", _score_sql("frequency", "ef", False))
        .replace("{M}", _score_sql("monetary", "em", False)))


@register("rfm")
def rfm(spark, d):
    return seg.rfm(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


oracle("rfm", f"WITH {_RFM}\nSELECT * FROM rfm")

_DESC = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in seg.SEGMENT_DESCRIPTIONS.items())


@register("rfm_segments")
def rfm_segments(spark, d):
    return seg.rfm_segments(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


oracle("rfm_segments", f"""WITH {_RFM},
descr AS (SELECT * FROM (VALUES {_DESC}) AS v(segment, description))
SELECT c.segment, c.customers, descr.description
FROM (SELECT segment, CAST(COUNT(*) AS BIGINT) AS customers FROM rfm GROUP BY segment) c
LEFT JOIN descr ON c.segment = descr.segment""")

_CP = """g AS (SELECT category, ROUND(COALESCE(SUM(sales), 0.0), 2) AS total, ROUND(AVG(sales), 2) AS average,
              CAST(COUNT(sales) AS BIGINT) AS count, ROUND(STDDEV_SAMP(sales), 2) AS std
       FROM sales WHERE category IS NOT NULL GROUP BY category),
cp AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY total DESC, category) AS BIGINT) AS rank, category, total, average,
              count, std, ROUND(total / SUM(total) OVER () * 100, 1) AS share_pct FROM g)"""


@register("category_performance")
def category_performance(spark, d):
    return seg.category_performance(sales(spark, d), "category", "sales")


oracle("category_performance", with_sales(f", {_CP}\nSELECT * FROM cp"))


@register("category_insights")
def category_insights(spark, d):
    return seg.category_insights(sales(spark, d), "category", "sales")


oracle("category_insights", with_sales(f""", {_CP},
x AS (SELECT arg_min(category, rank) AS top, arg_max(category, rank) AS bottom, arg_min(share_pct, rank) AS top_share,
             arg_min(total, rank) AS tt, arg_max(total, rank) AS bt, COUNT(*) AS n FROM cp)
SELECT CAST(top AS VARCHAR) AS top_performer, CAST(bottom AS VARCHAR) AS bottom_performer, top_share,
       ROUND(CASE WHEN bt > 0 THEN tt / bt ELSE 0.0 END, 4) AS top_bottom_ratio,
       printf('''%s'' leads with %s%% market share', top, CAST(top_share AS VARCHAR)) AS leader_insight,
       CASE WHEN n > 1 THEN 'Top-to-bottom ratio: ' || format('{{:.1f}}', CASE WHEN bt > 0 THEN tt / bt ELSE 0.0 END)
            || 'x' ELSE '' END AS ratio_insight FROM x"""))


@register("rfm_text")
def rfm_text(spark, d):
    """Recency, frequency and value by order with dates given as text."""
    m = seg.rfm_metrics(sales_dirty(spark, d), "order_id", "order_date_text", "quantity")
    return m.select("customer", "recency", "frequency", F.round("monetary", 2).alias("monetary"))


oracle("rfm_text", with_dirty("""
, t AS (SELECT order_id, TRY_STRPTIME(order_date_text, '%Y-%m-%d') AS dt, quantity FROM sales_dirty),
k AS (SELECT * FROM t WHERE dt IS NOT NULL AND quantity IS NOT NULL)
SELECT order_id AS customer, CAST(FLOOR((epoch((SELECT MAX(dt) FROM k)) - epoch(MAX(dt))) / 86400) AS BIGINT) AS recency,
       CAST(COUNT(*) AS BIGINT) AS frequency, ROUND(SUM(quantity), 2) AS monetary
FROM k GROUP BY order_id"""))


@register("kpi_time_text")
def kpi_time_text(spark, d):
    return kpi.mom_growth(sales_dirty(spark, d), "order_date_text", "quantity")


oracle("kpi_time_text", with_dirty("""
, m AS (SELECT strftime(TRY_STRPTIME(order_date_text, '%Y-%m-%d'), '%Y-%m') AS period, COALESCE(SUM(quantity), 0.0) AS value
        FROM sales_dirty WHERE TRY_STRPTIME(order_date_text, '%Y-%m-%d') IS NOT NULL GROUP BY 1),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY period DESC) AS r FROM m)
SELECT a.period AS last_period, ROUND(a.value, 2) AS last_value, ROUND(b.value, 2) AS previous_value,
       ROUND(CASE WHEN b.value > 0 THEN (a.value - b.value) / b.value * 100 END, 4) AS growth_pct
FROM (SELECT * FROM o WHERE r = 1) a LEFT JOIN (SELECT * FROM o WHERE r = 2) b ON TRUE"""))
