"""Cleaning queries (P6-P14, P22) on the ``sales_dirty`` fixture."""

from __future__ import annotations


from tessera.operators import clean as cl
from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.views import sales_dirty, table, with_dirty

_WS = r"'^\s+|\s+$', '', 'g'"


@register("to_numeric")
def to_numeric(spark, d):
    s = sales_dirty(spark, d)
    return cl.to_numeric(s.select("order_id", "amount_text"), ["amount_text"])


oracle("to_numeric", with_dirty("""
SELECT order_id, TRY_CAST(amount_text AS DOUBLE) AS amount_text FROM sales_dirty"""))


@register("parse_dates")
def parse_dates(spark, d):
    return cl.parse_dates(sales_dirty(spark, d).select("order_id", "order_date_text"))


oracle("parse_dates", with_dirty("""
SELECT order_id, TRY_STRPTIME(order_date_text, '%Y-%m-%d') AS order_date_text FROM sales_dirty"""))


@register("parse_dates_strict")
def parse_dates_strict(spark, d):
    s = sales_dirty(spark, d).select("order_id", "order_date_text")
    return cl.parse_dates(s, strict=True)


oracle("parse_dates_strict", with_dirty("""
SELECT order_id, order_date_text FROM sales_dirty"""))


@register("strip_whitespace")
def strip_whitespace(spark, d):
    return cl.strip_whitespace(sales_dirty(spark, d).select("order_id", "region"))


oracle("strip_whitespace", with_dirty(f"""
SELECT order_id, regexp_replace(region, {_WS}) AS region FROM sales_dirty"""))


@register("drop_empty")
def drop_empty(spark, d):
    return cl.drop_empty_columns(sales_dirty(spark, d))[0]


oracle("drop_empty", with_dirty("""
SELECT order_id, quantity, region, order_date_text, amount_text, constant_text FROM sales_dirty"""))


@register("dedupe")
def dedupe(spark, d):
    return cl.drop_duplicates(sales_dirty(spark, d))


oracle("dedupe", with_dirty("SELECT DISTINCT * FROM sales_dirty"))


def _fill_num(strategy):
    def q(spark, d):
        s = sales_dirty(spark, d).select("order_id", "quantity", "empty_num")
        return cl.fill_numeric(s, strategy)[0]
    return q


register("fill_numeric_median")(_fill_num("median"))
register("fill_numeric_mean")(_fill_num("mean"))
register("fill_numeric_zero")(_fill_num("zero"))
oracle("fill_numeric_median", with_dirty("""
SELECT order_id, COALESCE(quantity, (SELECT QUANTILE_CONT(quantity, 0.5) FROM sales_dirty)) AS quantity,
       empty_num FROM sales_dirty"""))
oracle("fill_numeric_mean", with_dirty("""
SELECT order_id, COALESCE(quantity, m) AS quantity, empty_num
FROM sales_dirty, (SELECT AVG(quantity) AS m FROM sales_dirty)"""))
oracle("fill_numeric_zero", with_dirty("""
SELECT order_id, COALESCE(quantity, 0.0) AS quantity, COALESCE(empty_num, 0.0) AS empty_num FROM sales_dirty"""))

_MODE = """(SELECT region FROM sales_dirty WHERE region IS NOT NULL GROUP BY region
            ORDER BY COUNT(*) DESC, region LIMIT 1)"""


@register("fill_categorical_mode")
def fill_categorical_mode(spark, d):
    return cl.fill_categorical(sales_dirty(spark, d).select("order_id", "region"), "mode")[0]


oracle("fill_categorical_mode", with_dirty(f"""
SELECT order_id, COALESCE(region, {_MODE}) AS region FROM sales_dirty"""))


@register("fill_categorical_unknown")
def fill_categorical_unknown(spark, d):
    return cl.fill_categorical(sales_dirty(spark, d).select("order_id", "region"), "unknown")[0]


oracle("fill_categorical_unknown", with_dirty("""
SELECT order_id, COALESCE(region, 'Unknown') AS region FROM sales_dirty"""))

_PIPE = f"""dd AS (SELECT DISTINCT * FROM sales_dirty),
med AS (SELECT QUANTILE_CONT(quantity, 0.5) AS m, COUNT(*) - COUNT(quantity) AS nq,
               COUNT(*) - COUNT(region) AS nr FROM dd),
md AS (SELECT region AS v FROM dd WHERE region IS NOT NULL GROUP BY region ORDER BY COUNT(*) DESC, region LIMIT 1)"""


@register("clean_pipeline")
def clean_pipeline(spark, d):
    return cl.clean(sales_dirty(spark, d))[0]


oracle("clean_pipeline", with_dirty(f""", {_PIPE}
SELECT order_id, COALESCE(quantity, med.m) AS quantity,
       regexp_replace(COALESCE(region, md.v), {_WS}) AS region,
       TRY_STRPTIME(order_date_text, '%Y-%m-%d') AS order_date_text,
       regexp_replace(amount_text, {_WS}) AS amount_text,
       regexp_replace(constant_text, {_WS}) AS constant_text
FROM dd, med, md"""))


@register("cleaning_report")
def cleaning_report(spark, d):
    return cl.clean(sales_dirty(spark, d))[1]


oracle("cleaning_report", with_dirty(f""", {_PIPE}
SELECT ord, step, column_name, CAST(amount AS BIGINT) AS amount, value FROM (VALUES
  (0, 'rows_before', NULL, (SELECT COUNT(*) FROM sales_dirty), NULL),
  (1, 'duplicates', NULL, (SELECT COUNT(*) FROM sales_dirty) - (SELECT COUNT(*) FROM dd), NULL),
  (2, 'rows_after', NULL, (SELECT COUNT(*) FROM dd), NULL),
  (3, 'columns_before', NULL, 7, NULL),
  (4, 'columns_after', NULL, 6, NULL),
  (5, 'fill_numbers', 'quantity', (SELECT nq FROM med), (SELECT printf('%.2f', m) FROM med)),
  (6, 'fill_texts', 'region', (SELECT nr FROM med), (SELECT v FROM md)),
  (7, 'read_dates', 'order_date_text', (SELECT COUNT(TRY_STRPTIME(order_date_text, '%Y-%m-%d')) FROM dd), NULL),
  (8, 'strip_edges', 'region', (SELECT COUNT(*) FROM dd), NULL),
  (9, 'strip_edges', 'amount_text', (SELECT COUNT(*) FROM dd), NULL),
  (10, 'strip_edges', 'constant_text', (SELECT COUNT(*) FROM dd), NULL),
  (11, 'drop_empties', 'empty_num', (SELECT COUNT(*) FROM dd), NULL)) AS r(ord, step, column_name, amount, value)"""))


@register("narrow_types")
def narrow_types(spark, d):
    return cl.narrow_types(table(spark, d, "lineitem"))[1]


oracle("narrow_types", """
SELECT column_name, from_type, to_type FROM (VALUES
  ('l_orderkey', 'bigint', CASE WHEN (SELECT MAX(l_orderkey) FROM lineitem) <= 127
                                 AND (SELECT MIN(l_orderkey) FROM lineitem) >= -128 THEN 'tinyint'
                                WHEN (SELECT MAX(l_orderkey) FROM lineitem) <= 32767
                                 AND (SELECT MIN(l_orderkey) FROM lineitem) >= -32768 THEN 'smallint'
                                ELSE 'int' END),
  ('l_partkey', 'bigint', CASE WHEN (SELECT MAX(l_partkey) FROM lineitem) <= 127 THEN 'tinyint'
                               WHEN (SELECT MAX(l_partkey) FROM lineitem) <= 32767 THEN 'smallint'
                               ELSE 'int' END),
  ('l_suppkey', 'bigint', CASE WHEN (SELECT MAX(l_suppkey) FROM lineitem) <= 127 THEN 'tinyint'
                               WHEN (SELECT MAX(l_suppkey) FROM lineitem) <= 32767 THEN 'smallint'
                               ELSE 'int' END),
  ('l_linenumber', 'int', 'tinyint')) AS v(column_name, from_type, to_type)
UNION ALL
SELECT c, 'double', 'float' FROM (
  SELECT 'l_quantity' AS c, MAX(ABS(l_quantity - CAST(CAST(l_quantity AS FLOAT) AS DOUBLE))
                                / GREATEST(ABS(l_quantity), 1.0)) AS e FROM lineitem
  UNION ALL SELECT 'l_extendedprice', MAX(ABS(l_extendedprice - CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE))
                                / GREATEST(ABS(l_extendedprice), 1.0)) FROM lineitem
  UNION ALL SELECT 'l_discount', MAX(ABS(l_discount - CAST(CAST(l_discount AS FLOAT) AS DOUBLE))
                                / GREATEST(ABS(l_discount), 1.0)) FROM lineitem
  UNION ALL SELECT 'l_tax', MAX(ABS(l_tax - CAST(CAST(l_tax AS FLOAT) AS DOUBLE))
                                / GREATEST(ABS(l_tax), 1.0)) FROM lineitem) WHERE e <= 1e-6""")

