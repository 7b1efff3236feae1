"""Question-table and answer queries (P5, P28, P29, D23, D30-D32, ask)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import questions as qs
from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.q_eda import _pairs_sql
from tessera.plans.views import sales, table, with_sales

# Column lists of the `sales` fixture (schema facts, used by the oracle SQL).
SALES_NUM = ["order_id", "line_no", "customer_id", "quantity", "sales", "profit", "discount"]
SALES_CAT = ["product", "category", "region"]


def _user_questions(spark, d):
    c = table(spark, d, "conversations")
    return c.where(F.col("role") == "user").select("conv_id", "turn", "text")


def _classified(spark, d, version=2):
    return qs.classify_questions(_user_questions(spark, d), "text", sales(spark, d), version)


def _cascade_sql(rules, default):
    parts = []
    for name, words in rules:
        cond = " OR ".join(f"contains(lower(text), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + f" ELSE '{default}' END"


def _words(c):
    return [w for w in c.lower().replace("_", " ").split() if len(w) > 2]


def _match_sql(cols, version=2):
    if version == 2:
        parts = []
        for c in cols:
            cond = " OR ".join(f"contains(lower(text), '{w}')" for w in [c.lower()] + _words(c))
            parts.append(f"WHEN {cond} THEN '{c}'")
        return "CASE " + " ".join(parts) + " END"
    full = [f"WHEN contains(lower(text), '{c.lower()}') THEN '{c}'" for c in cols]
    part = [f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in _words(c))} THEN '{c}'"
            for c in cols if _words(c)]
    return "CASE " + " ".join(full + part) + " END"


_TOPN = "CAST(LEAST(COALESCE(TRY_CAST(regexp_extract(text, '\\d+', 0) AS DECIMAL(38,0)), 5), 20) AS BIGINT)"
_Q = "FROM conversations WHERE role = 'user'"


@register("question_intents")
def question_intents(spark, d):
    return _classified(spark, d).select("conv_id", "turn", "intent")


oracle("question_intents", f"SELECT conv_id, turn, {_cascade_sql(qs.INTENTS_V2, qs.DEFAULT_INTENT_V2)} AS intent {_Q}")


@register("question_intents_v1")
def question_intents_v1(spark, d):
    return _classified(spark, d, 1).select("conv_id", "turn", "intent")


oracle("question_intents_v1",
       f"SELECT conv_id, turn, {_cascade_sql(qs.INTENTS_V1, qs.DEFAULT_INTENT_V1)} AS intent {_Q}")


@register("question_topn")
def question_topn(spark, d):
    return _classified(spark, d).select("conv_id", "turn", "top_n")


oracle("question_topn", f"SELECT conv_id, turn, {_TOPN} AS top_n {_Q}")


@register("question_columns")
def question_columns(spark, d):
    return _classified(spark, d).select("conv_id", "turn", "numeric_column", "text_column")


oracle("question_columns", f"""SELECT conv_id, turn, {_match_sql(SALES_NUM)} AS numeric_column,
       {_match_sql(SALES_CAT)} AS text_column {_Q}""")


@register("question_columns_v1")
def question_columns_v1(spark, d):
    return _classified(spark, d, 1).select("conv_id", "turn", "numeric_column", "text_column")


oracle("question_columns_v1", f"""SELECT conv_id, turn, {_match_sql(SALES_NUM, 1)} AS numeric_column,
       {_match_sql(SALES_CAT, 1)} AS text_column {_Q}""")


@register("overview")
def overview(spark, d):
    return qs.overview(sales(spark, d))


oracle("overview", with_sales(f"""
, g AS (SELECT COUNT(*) AS k FROM sales GROUP BY ALL_COLS)
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM sales) AS rows, CAST(11 AS BIGINT) AS columns,
       CAST({len(SALES_NUM)} AS BIGINT) AS numeric_columns, CAST({len(SALES_CAT)} AS BIGINT) AS text_columns,
       (SELECT CAST({' + '.join(f'(COUNT(*) - COUNT({c}))' for c in SALES_NUM + SALES_CAT + ['order_date'])} AS BIGINT)
        FROM sales) AS missing_values,
       (SELECT CAST(COALESCE(SUM(k - 1), 0) AS BIGINT) FROM g) AS duplicate_rows""".replace(
    "ALL_COLS", ", ".join(["order_id", "line_no", "order_date", "customer_id", "product", "category", "region",
                           "quantity", "sales", "profit", "discount"]))))


@register("overview_numeric")
def overview_numeric(spark, d):
    return qs.overview_numeric(sales(spark, d))


oracle("overview_numeric", with_sales("\n" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name,
  ROUND(COALESCE(SUM(CAST({c} AS DOUBLE)), 0.0), 2) AS total, ROUND(AVG(CAST({c} AS DOUBLE)), 2) AS mean,
  ROUND(MIN(CAST({c} AS DOUBLE)), 2) AS min, ROUND(MAX(CAST({c} AS DOUBLE)), 2) AS max FROM sales"""
                                                                   for c in SALES_NUM)))


@register("suggested_bar_data")
def suggested_bar_data(spark, d):
    return qs.suggested_bar_data(sales(spark, d), 8)


oracle("suggested_bar_data", with_sales("""
SELECT CAST(product AS VARCHAR) AS category, ROUND(v, 2) AS value FROM (
  SELECT product, COALESCE(SUM(CAST(order_id AS DOUBLE)), 0.0) AS v FROM sales WHERE product IS NOT NULL
  GROUP BY product ORDER BY v DESC, product LIMIT 8)"""))


@register("chart_data")
def chart_data(spark, d):
    """Bars, scatter grid, line, histogram and heatmap of the sales table."""
    return qs.chart_data(sales(spark, d))


_CELL = "CAST(LEAST(FLOOR(COALESCE(({c} - {c}_lo) / NULLIF({c}_hi - {c}_lo, 0), 0) * 30), 29) AS BIGINT)"
oracle("chart_data", with_sales(f"""
, r AS (SELECT MIN(order_id)::DOUBLE AS order_id_lo, MAX(order_id)::DOUBLE AS order_id_hi, MIN(line_no)::DOUBLE AS line_no_lo, MAX(line_no)::DOUBLE AS line_no_hi FROM sales)
SELECT CAST(1 AS INTEGER) AS rank, 'Bar Chart' AS chart, product AS x, CAST(NULL AS VARCHAR) AS y, ROUND(v, 2) AS value FROM (
  SELECT product, SUM(CAST(order_id AS DOUBLE)) AS v FROM sales WHERE product IS NOT NULL GROUP BY product ORDER BY v DESC, product LIMIT 8)
UNION ALL SELECT 2, 'Scatter', CAST({_CELL.format(c='order_id')} AS VARCHAR), CAST({_CELL.format(c='line_no')} AS VARCHAR), CAST(COUNT(*) AS DOUBLE)
  FROM sales, r WHERE order_id IS NOT NULL AND line_no IS NOT NULL GROUP BY 3, 4
UNION ALL SELECT 3, 'Line', strftime(order_date, '%Y-%m'), NULL, ROUND(SUM(CAST(order_id AS DOUBLE)), 2)
  FROM sales WHERE order_date IS NOT NULL AND order_id IS NOT NULL GROUP BY 3
UNION ALL SELECT 4, 'Histogram', CAST(CAST(LEAST(FLOOR((order_id - order_id_lo) / ((order_id_hi - order_id_lo) / 30)), 29) AS BIGINT) AS VARCHAR), NULL,
  CAST(COUNT(*) AS DOUBLE) FROM sales, r WHERE order_id IS NOT NULL GROUP BY 3
UNION ALL SELECT 5, 'Heatmap', col1, col2, correlation FROM ({_pairs_sql('sales', SALES_NUM)})"""))


@register("business_insights")
def business_insights(spark, d):
    return qs.business_insights(sales(spark, d))


oracle("business_insights", with_sales("""
SELECT CAST(41 AS BIGINT) AS ord, 'sales' AS column_name, 'total' AS kind,
       ROUND(COALESCE(SUM(sales), 0.0), 2) AS value, CAST(NULL AS VARCHAR) AS label FROM sales
UNION ALL SELECT 42, 'sales', 'mean', ROUND(AVG(sales), 2), NULL FROM sales
UNION ALL SELECT 43, 'sales', 'top product', NULL, (SELECT product FROM sales WHERE product IS NOT NULL
  GROUP BY product ORDER BY COALESCE(SUM(sales), 0.0) DESC, product LIMIT 1)
UNION ALL SELECT 54, 'profit', 'negative rows', CAST(COUNT(*) AS DOUBLE), NULL FROM sales
  WHERE profit < 0 HAVING COUNT(*) > 0"""))


@register("dataset_context")
def dataset_context(spark, d):
    return qs.dataset_context(sales(spark, d))


_JSON = " || ',' || ".join(f"""'"{c}":' || """ + (f"'\"' || {c} || '\"'" if c in SALES_CAT else
                           f"'\"' || strftime({c}, '%Y-%m-%dT%H:%M:%S') || '.000\"'" if c == "order_date" else
                           f"CAST({c} AS VARCHAR)" if c.endswith("_id") or c == "line_no" else f"CAST(ROUND({c}, 4) AS VARCHAR)")
                           for c in ["order_id", "line_no", "order_date", "customer_id", "product", "category", "region", "quantity", "sales", "profit", "discount"])

oracle("dataset_context", with_sales("""
SELECT 'shape' AS section, 'rows' AS name, CAST(COUNT(*) AS VARCHAR) AS value FROM sales UNION ALL SELECT 'shape', 'columns', '11'
""" + "".join(f"""UNION ALL SELECT 'numeric', '{c}', format('sum={{:.2f}}, mean={{:.2f}}, min={{:.2f}}, max={{:.2f}}', ROUND(SUM(CAST({c} AS DOUBLE)), 2),
  ROUND(AVG(CAST({c} AS DOUBLE)), 2), ROUND(MIN(CAST({c} AS DOUBLE)), 2), ROUND(MAX(CAST({c} AS DOUBLE)), 2)) FROM sales
""" for c in SALES_NUM) + "".join(f"""UNION ALL SELECT 'top_values', '{c}', string_agg(t, '; ' ORDER BY i) FROM (
  SELECT {c} || '=' || COUNT(*) AS t, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS i FROM sales GROUP BY {c}) WHERE i <= 5
""" for c in SALES_CAT) + f"""UNION ALL SELECT * FROM (SELECT 'sample', 'row', '{{' || {_JSON} || '}}' FROM sales ORDER BY ALL_COLS LIMIT 3)""".replace(
    "ALL_COLS", "order_id, line_no, order_date, customer_id, product, category, region, quantity, sales, profit, discount")))


@register("ask")
def ask(spark, d):
    """No column is called "categories", so the first text column is taken."""
    return qs.ask(sales(spark, d), "What are the top 5 categories by sales?")


oracle("ask", with_sales("""
SELECT product, ROUND(COALESCE(SUM(sales), 0.0), 2) AS value FROM sales WHERE product IS NOT NULL
GROUP BY product ORDER BY COALESCE(SUM(sales), 0.0) DESC, product LIMIT 5"""))


@register("ask_count")
def ask_count(spark, d):
    return qs.ask(sales(spark, d), "How many rows of each region?", version=1)


oracle("ask_count", with_sales("""
SELECT region AS value, CAST(COUNT(*) AS BIGINT) AS count, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sales), 4) AS pct
FROM sales WHERE region IS NOT NULL GROUP BY region"""))


@register("overview_text")
def overview_text(spark, d):
    return qs.overview_text(sales(spark, d))


oracle("overview_text", with_sales("\n" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, "unique", CAST(rank AS BIGINT) AS rank, value, count FROM (
  SELECT {c} AS value, CAST(COUNT(*) AS BIGINT) AS count, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS rank,
         CAST(COUNT(*) OVER () AS BIGINT) AS "unique" FROM sales WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 3""" for c in SALES_CAT)))


@register("business_insights_v1")
def business_insights_v1(spark, d):
    return qs.business_insights_v1(sales(spark, d))


oracle("business_insights_v1", with_sales("""
SELECT 'total' AS kind, 'sales' AS column_name, CAST(NULL AS VARCHAR) AS label, ROUND(SUM(sales), 2) AS value FROM sales
UNION ALL SELECT 'mean', 'sales', NULL, ROUND(AVG(sales), 2) FROM sales
UNION ALL SELECT 'profit total', 'profit', NULL, ROUND(SUM(profit), 2) FROM sales
UNION ALL SELECT 'negative rows', 'profit', NULL, CAST(COUNT(*) AS DOUBLE) FROM sales WHERE profit < 0 HAVING COUNT(*) > 0
UNION ALL """ + " UNION ALL ".join(f"""SELECT * FROM (SELECT 'top {c}', '{n}', {c}, ROUND(SUM(CAST({n} AS DOUBLE)), 2) FROM sales
  WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY SUM(CAST({n} AS DOUBLE)) DESC, {c} LIMIT 1)""" for c in SALES_CAT for n in SALES_NUM) + """
UNION ALL SELECT * FROM (SELECT 'share', 'product', product, ROUND(ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sales), 4), 1) FROM sales
  WHERE product IS NOT NULL GROUP BY product ORDER BY COUNT(*) DESC, product LIMIT 5)"""))


