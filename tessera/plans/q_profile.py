"""Profiling / validation queries."""

from __future__ import annotations

from tessera.operators import profile as pr
from tessera.functions.schema import ROLE_KEYWORDS
from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.views import sales, sales_dirty, table, with_dirty, with_sales

# Static schemas of the checked inputs, spelled as Spark type names.
DIRTY_COLS = [("order_id", "bigint"), ("quantity", "double"), ("region", "string"),
              ("order_date_text", "string"), ("amount_text", "string"), ("empty_num", "double"),
              ("constant_text", "string")]
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")]
DOC_TEXT = ["text", "lang", "source"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@register("column_info")
def column_info(spark, d):
    return pr.column_info(sales_dirty(spark, d))


oracle("column_info", with_dirty(_union([f"""
SELECT '{c}' AS column_name, '{t}' AS data_type, CAST(COUNT("{c}") AS BIGINT) AS non_null,
       CAST(COUNT(*) - COUNT("{c}") AS BIGINT) AS nulls,
       ROUND((COUNT(*) - COUNT("{c}")) * 100.0 / COUNT(*), 2) AS null_pct,
       CAST(COUNT(DISTINCT "{c}") AS BIGINT) AS "unique" FROM sales_dirty""" for c, t in DIRTY_COLS])))


@register("missing_by_column")
def missing_by_column(spark, d):
    return pr.missing_by_column(sales_dirty(spark, d))


oracle("missing_by_column", with_dirty(_union([f"""
SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT("{c}") AS BIGINT) AS missing_count,
       ROUND((COUNT(*) - COUNT("{c}")) * 100.0 / COUNT(*), 2) AS missing_pct FROM sales_dirty"""
                                                   for c, _ in DIRTY_COLS])))


@register("cardinality")
def cardinality(spark, d):
    return pr.cardinality(table(spark, d, "customer"))


oracle("cardinality", _union([f"""
SELECT '{c}' AS column_name, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS "unique",
       ROUND(COUNT(DISTINCT {c}) * 1.0 / COUNT(*), 4) AS ratio, COUNT(DISTINCT {c}) <= 1 AS is_constant
FROM customer""" for c, _ in CUSTOMER_COLS]))


@register("describe_numeric")
def describe_numeric(spark, d):
    return pr.describe_numeric(table(spark, d, "lineitem"))


oracle("describe_numeric", _union([f"""
SELECT '{c}' AS column_name, CAST(COUNT({c}) AS BIGINT) AS count, ROUND(AVG({c}), 4) AS mean,
       ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c}), 4) AS min,
       ROUND(QUANTILE_CONT({c}, 0.25), 4) AS q25, ROUND(QUANTILE_CONT({c}, 0.5), 4) AS q50,
       ROUND(QUANTILE_CONT({c}, 0.75), 4) AS q75, ROUND(MAX({c}), 4) AS max FROM lineitem"""
                                           for c in LINEITEM_NUM]))


@register("describe_timestamp")
def describe_timestamp(spark, d):
    return pr.describe_timestamp(table(spark, d, "orders"))


oracle("describe_timestamp", """
WITH e AS (SELECT CAST(epoch_us(o_orderdate) AS DOUBLE) AS v FROM orders)
SELECT 'o_orderdate' AS column_name, CAST(COUNT(v) AS BIGINT) AS count,
       make_timestamp(CAST(ROUND(AVG(v)) AS BIGINT)) AS mean,
       make_timestamp(CAST(ROUND(MIN(v)) AS BIGINT)) AS min,
       make_timestamp(CAST(ROUND(QUANTILE_CONT(v, 0.25)) AS BIGINT)) AS q25,
       make_timestamp(CAST(ROUND(QUANTILE_CONT(v, 0.5)) AS BIGINT)) AS q50,
       make_timestamp(CAST(ROUND(QUANTILE_CONT(v, 0.75)) AS BIGINT)) AS q75,
       make_timestamp(CAST(ROUND(MAX(v)) AS BIGINT)) AS max FROM e""")


_VCOLS = _union([f"""
SELECT '{c}' AS column_name, '{t}' AS data_type, CAST(COUNT(*) - COUNT("{c}") AS BIGINT) AS missing_count,
       ROUND((COUNT(*) - COUNT("{c}")) * 100.0 / COUNT(*), 2) AS missing_pct,
       CAST(COUNT(DISTINCT "{c}") AS BIGINT) AS unique_count,
       ROUND(COUNT(DISTINCT "{c}") * 1.0 / COUNT(*), 4) AS cardinality_ratio,
       COUNT(DISTINCT "{c}") <= 1 AS is_constant, {str(t == 'string').upper()} AS is_string
FROM sales_dirty""" for c, t in DIRTY_COLS])


@register("validate_columns")
def validate_columns(spark, d):
    return pr.validate_columns(sales_dirty(spark, d))


oracle("validate_columns", with_dirty(f""", v AS ({_VCOLS})
SELECT column_name, data_type, missing_count, missing_pct, unique_count, cardinality_ratio, is_constant,
       CASE WHEN missing_pct > 30 THEN CAST(missing_pct AS VARCHAR) || '% missing — consider dropping'
            ELSE '' END AS issues,
       concat_ws('; ',
         CASE WHEN is_constant THEN 'Constant column (0 variance)' END,
         CASE WHEN missing_pct <= 30 AND missing_pct > 5 THEN CAST(missing_pct AS VARCHAR) || '% missing' END,
         CASE WHEN cardinality_ratio > 0.95 AND is_string THEN 'High cardinality — possible ID column' END
       ) AS warnings
FROM v"""))

_DS = f"""n AS (SELECT COUNT(*) AS rows, {' + '.join(f'(COUNT(*) - COUNT("{c}"))' for c, _ in DIRTY_COLS)}
              AS total_missing FROM sales_dirty),
g AS (SELECT COUNT(*) AS k FROM sales_dirty GROUP BY ALL_COLS),
dup AS (SELECT COALESCE(SUM(k - 1), 0) AS duplicate_rows FROM g)"""
_DS = _DS.replace("ALL_COLS", ", ".join(f'"{c}"' for c, _ in DIRTY_COLS))


@register("validate_dataset")
def validate_dataset(spark, d):
    return pr.validate_dataset(sales_dirty(spark, d))


oracle("validate_dataset", with_dirty(f""", {_DS},
x AS (SELECT n.rows, n.total_missing, dup.duplicate_rows,
             n.total_missing * 100.0 / (n.rows * {len(DIRTY_COLS)}) AS miss_pct,
             dup.duplicate_rows * 100.0 / n.rows AS dup_pct FROM n, dup),
y AS (SELECT *, concat_ws('; ',
         CASE WHEN rows = 0 THEN 'Dataset is empty (0 rows)' END,
         CASE WHEN rows > 0 AND miss_pct > 30
              THEN printf('%d missing values (%.1f%%) — critical', total_missing, miss_pct) END) AS issues,
       concat_ws('; ',
         CASE WHEN rows > 0 AND duplicate_rows > 0
              THEN printf('%d duplicate rows (%.1f%%)', duplicate_rows, dup_pct) END,
         CASE WHEN rows > 0 AND miss_pct <= 30 AND miss_pct > 5
              THEN printf('%d missing values (%.1f%%)', total_missing, miss_pct) END) AS warnings
      FROM x)
SELECT CAST(rows AS BIGINT) AS total_rows, CAST({len(DIRTY_COLS)} AS BIGINT) AS total_columns,
       CAST(duplicate_rows AS BIGINT) AS duplicate_rows, CAST(total_missing AS BIGINT) AS total_missing,
       issues = '' AS is_valid, issues, warnings FROM y"""))


@register("quality_flags")
def quality_flags(spark, d):
    return pr.quality_flags(sales_dirty(spark, d))


oracle("quality_flags", with_dirty(f""", {_DS}
SELECT total_missing > 0 AS has_missing, duplicate_rows > 0 AS has_duplicates,
       concat_ws('; ', CASE WHEN total_missing > 0 THEN printf('%d missing values', total_missing) END,
                       CASE WHEN duplicate_rows > 0 THEN printf('%d duplicate rows', duplicate_rows) END) AS issues
FROM n, dup"""))


_STRINGS = [c for c, t in DIRTY_COLS if t == "string"]


@register("quality_score")
def quality_score(spark, d):
    return pr.quality_score(sales_dirty(spark, d))


oracle("quality_score", with_dirty(f""", {_DS},
c AS (SELECT {' + '.join(f'(CASE WHEN COUNT(DISTINCT "{c}") <= 1 THEN 1 ELSE 0 END)' for c, _ in DIRTY_COLS)}
             AS constant,
             {' + '.join(f'(CASE WHEN COUNT("{c}") > 0 AND COUNT(TRY_CAST("{c}" AS DOUBLE)) > COUNT("{c}") * 0.5 THEN 1 ELSE 0 END)' for c in _STRINGS)}
             AS numeric_like FROM sales_dirty),
s AS (SELECT ROUND(GREATEST(0.0, 100.0
        - LEAST(30.0, n.total_missing * 100.0 / (n.rows * {len(DIRTY_COLS)}) * 1.5)
        - LEAST(15.0, dup.duplicate_rows * 100.0 / n.rows * 0.5)
        - LEAST(10.0, c.constant / {float(len(DIRTY_COLS))} * 30)
        - LEAST(10.0, c.numeric_like / {float(len(DIRTY_COLS))} * 30)), 1) AS score, *
      FROM n, dup, c)
SELECT score AS quality_score,
       CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good'
            WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS tier,
       CAST(total_missing AS BIGINT) AS total_missing, CAST(duplicate_rows AS BIGINT) AS duplicate_rows,
       CAST(constant AS BIGINT) AS constant_columns, CAST(numeric_like AS BIGINT) AS numeric_like_columns
FROM s"""))


def _role_case(expr: str) -> str:
    parts = []
    for role, kws in ROLE_KEYWORDS.items():
        cond = " OR ".join(f"contains(lower({expr}), '{k}')" for k in kws)
        parts.append(f"WHEN {cond} THEN '{role}'")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


@register("dictionary_candidates")
def dictionary_candidates(spark, d):
    return pr.dictionary_candidates(table(spark, d, "documents"))


oracle("dictionary_candidates", "SELECT column_name, \"unique\", ratio FROM (" + _union([f"""
SELECT '{c}' AS column_name, CAST(COUNT(DISTINCT "{c}") AS BIGINT) AS "unique",
       ROUND(COUNT(DISTINCT "{c}") * 1.0 / COUNT(*), 4) AS ratio,
       COUNT(DISTINCT "{c}") * 1.0 / COUNT(*) AS r FROM documents""" for c in DOC_TEXT]) +
       ") WHERE r < 0.5".replace("SELECT * FROM", "SELECT * FROM"))


@register("column_profile")
def column_profile(spark, d):
    return pr.column_profile(sales_dirty(spark, d))


def _profile_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(DIRTY_COLS):
        num = t in ("bigint", "double", "int")
        role = _role_case(f"'{c}'")
        if t == "string":
            top = f"""(SELECT string_agg(v || '=' || CAST(n AS VARCHAR), '; ' ORDER BY n DESC, v)
                       FROM (SELECT "{c}" AS v, COUNT(*) AS n FROM sales_dirty WHERE "{c}" IS NOT NULL
                             GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"""
        else:
            top = "CAST(NULL AS VARCHAR)"
        if num:
            x = f'CAST("{c}" AS DOUBLE)'
            st = (f"ROUND(AVG({x}), 4) AS mean, ROUND(QUANTILE_CONT({x}, 0.5), 4) AS median, "
                  f"ROUND(STDDEV_SAMP({x}), 4) AS std, ROUND(MIN({x}), 4) AS min, ROUND(MAX({x}), 4) AS max, "
                  f"ROUND(CASE WHEN COUNT({x}) < 3 THEN NULL WHEN COALESCE(STDDEV_POP({x}), 0) = 0 THEN 0.0 "
                  f"ELSE SKEWNESS({x}) END, 4) AS skew, "
                  f"ROUND(CASE WHEN COUNT({x}) < 4 THEN NULL WHEN COALESCE(STDDEV_POP({x}), 0) = 0 THEN 0.0 "
                  f"ELSE KURTOSIS({x}) END, 4) AS kurtosis")
        else:
            st = ("CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS std, "
                  "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS skew, "
                  "CAST(NULL AS DOUBLE) AS kurtosis")
        parts.append(f"""
SELECT '{c}' AS column_name, '{t}' AS data_type, {role} AS role,
       CAST(COUNT(*) - COUNT("{c}") AS BIGINT) AS missing_count,
       ROUND((COUNT(*) - COUNT("{c}")) * 100.0 / COUNT(*), 2) AS missing_pct,
       CAST(COUNT(DISTINCT "{c}") AS BIGINT) AS unique_count, {top} AS top_values, {st}
FROM sales_dirty""")
    return with_dirty(_union(parts))


oracle("column_profile", _profile_sql())
