"""EDA / outlier / distribution queries."""

from __future__ import annotations

from tessera.operators import eda
from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.views import sales, table, with_sales

LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
      "l_extendedprice", "l_discount", "l_tax"]
FEATURES = ["user_id", "value"]  # on events: value is skewed and has outliers
EV = ["event_id", "user_id", "value"]


def _u(parts):
    return "\nUNION ALL\n".join(parts)


def _g1(x):
    return (f"CASE WHEN COUNT({x}) < 3 THEN NULL WHEN COALESCE(STDDEV_POP({x}), 0) = 0 THEN 0.0 "
            f"ELSE SKEWNESS({x}) END")


def _g2(x):
    return (f"CASE WHEN COUNT({x}) < 4 THEN NULL WHEN COALESCE(STDDEV_POP({x}), 0) = 0 THEN 0.0 "
            f"ELSE KURTOSIS({x}) END")


def _univariate_sql(tab: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        z = lambda e: f"ROUND(COALESCE({e}, 0.0), 4)"
        parts.append(f"""
SELECT '{c}' AS column_name, CAST(COUNT({x}) AS BIGINT) AS count, {z(f'AVG({x})')} AS mean,
  {z(f'QUANTILE_CONT({x}, 0.5)')} AS median, {z(f'STDDEV_SAMP({x})')} AS std, {z(f'VAR_SAMP({x})')} AS variance,
  {z(_g1(x))} AS skewness, {z(_g2(x))} AS kurtosis, {z(f'MIN({x})')} AS min, {z(f'MAX({x})')} AS max,
  {z(f'QUANTILE_CONT({x}, 0.25)')} AS q1, {z(f'QUANTILE_CONT({x}, 0.75)')} AS q3,
  {z(f'QUANTILE_CONT({x}, 0.75) - QUANTILE_CONT({x}, 0.25)')} AS iqr,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM {tab}, (SELECT QUANTILE_CONT({x}, 0.25) AS a, QUANTILE_CONT({x}, 0.75) AS b
      FROM {tab}) qq WHERE {x} < a - 1.5 * (b - a) OR {x} > b + 1.5 * (b - a)) AS outlier_count,
  (SELECT v FROM (SELECT {x} AS v, COUNT(*) AS n FROM {tab} WHERE {c} IS NOT NULL GROUP BY 1)
      ORDER BY n DESC, v LIMIT 1) AS mode
FROM {tab}""")
    return _u(parts)


@register("univariate_stats")
def univariate_stats(spark, d):
    return eda.univariate(table(spark, d, "lineitem"))


oracle("univariate_stats", _univariate_sql("lineitem", LI))


def _pairs_sql(tab: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            lo, hi = (a, b) if i <= j else (b, a)
            r = (f"ROUND(regr_sxy(CAST({hi} AS DOUBLE), CAST({lo} AS DOUBLE)) / "
                 f"SQRT(regr_sxx(CAST({hi} AS DOUBLE), CAST({lo} AS DOUBLE)) * "
                 f"regr_syy(CAST({hi} AS DOUBLE), CAST({lo} AS DOUBLE))), 4)")
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {i} AS i, {j} AS j, {r} AS correlation FROM {tab}")
    return _u(parts)


@register("corr_matrix")
def corr_matrix(spark, d):
    return eda.corr_matrix(table(spark, d, "lineitem"))


oracle("corr_matrix", f"SELECT col1, col2, correlation FROM ({_pairs_sql('lineitem', LI)})")


@register("top_correlations")
def top_correlations(spark, d):
    return eda.top_correlations(table(spark, d, "lineitem"), 10)


_TOPC = f"""SELECT col1, col2, correlation,
  CASE WHEN ABS(correlation) >= 0.7 THEN 'strong' WHEN ABS(correlation) >= 0.4 THEN 'moderate' ELSE 'weak' END
  AS strength, i, j
FROM ({_pairs_sql('lineitem', LI)}) WHERE i < j ORDER BY ABS(correlation) DESC NULLS LAST, i, j"""
oracle("top_correlations", f"SELECT col1, col2, correlation, strength FROM ({_TOPC} LIMIT 10)")

PART_TEXT = ["p_name", "p_brand", "p_type"]


@register("categorical_summary")
def categorical_summary(spark, d):
    return eda.categorical_summary(table(spark, d, "part"))


oracle("categorical_summary", _u([f"""
SELECT '{c}' AS column_name, (SELECT CAST(COUNT(DISTINCT {c}) AS BIGINT) FROM part) AS "unique",
       (SELECT CAST(COUNT({c}) AS BIGINT) FROM part) AS non_null,
       CAST(ROW_NUMBER() OVER (ORDER BY n DESC, v) AS BIGINT) AS rank, v AS value, CAST(n AS BIGINT) AS count
FROM (SELECT {c} AS v, COUNT(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)"""
                                       for c in PART_TEXT]))


@register("eda_insights")
def eda_insights(spark, d):
    return eda.eda_insights(table(spark, d, "events"))


_TOPC_EV = _TOPC.replace(_pairs_sql('lineitem', LI), _pairs_sql('events', EV))
oracle("eda_insights", f"""
WITH u AS ({_univariate_sql('events', EV)}),
t AS ({_TOPC_EV} LIMIT 3)
SELECT 'skew' AS kind, column_name,
       printf('''%s'' is highly skewed to the %s (%s)', column_name,
              CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END, format('{{:.2f}}', skewness)) AS message
FROM u WHERE ABS(skewness) > 1
UNION ALL
SELECT 'outliers', column_name,
       printf('''%s'' has %d outliers (%s%%)', column_name, outlier_count,
              format('{{:.1f}}', outlier_count * 100.0 / count)) FROM u WHERE outlier_count > 0
UNION ALL
SELECT 'correlation', col1 || '|' || col2,
       printf('Strong correlation between ''%s'' and ''%s'' (%s)', col1, col2, format('{{:.3f}}', correlation))
FROM t WHERE strength = 'strong'""")


def _iqr_cte(tab: str, cols: list[str]) -> str:
    return ", ".join(f"QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS a{i}, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS b{i}"
                     for i, c in enumerate(cols))


@register("iqr_bounds")
def iqr_bounds(spark, d):
    return eda.iqr_bounds(table(spark, d, "events"), FEATURES)


oracle("iqr_bounds", f"""WITH q AS (SELECT {_iqr_cte('events', FEATURES)} FROM events)
""" + _u([f"""SELECT '{c}' AS column_name, ROUND(a{i}, 4) AS q1, ROUND(b{i}, 4) AS q3,
       ROUND(a{i} - 1.5 * (b{i} - a{i}), 2) AS lower, ROUND(b{i} + 1.5 * (b{i} - a{i}), 2) AS upper,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM events WHERE {c} < a{i} - 1.5 * (b{i} - a{i})
                                                   OR {c} > b{i} + 1.5 * (b{i} - a{i})) AS outliers
FROM q""" for i, c in enumerate(FEATURES)]))

_IQR_FLAG = " OR ".join(f"COALESCE({c} < a{i} - 1.5 * (b{i} - a{i}) OR {c} > b{i} + 1.5 * (b{i} - a{i}), FALSE)"
                        for i, c in enumerate(FEATURES))


@register("iqr_flag")
def iqr_flag(spark, d):
    return eda.anomaly_summary(eda.iqr_flags(table(spark, d, "events"), FEATURES), "IQR")


oracle("iqr_flag", f"""WITH q AS (SELECT {_iqr_cte('events', FEATURES)} FROM events)
SELECT 'IQR' AS method, CAST(COUNT(*) FILTER (WHERE {_IQR_FLAG}) AS BIGINT) AS anomaly_count,
       ROUND(COUNT(*) FILTER (WHERE {_IQR_FLAG}) * 100.0 / COUNT(*), 2) AS anomaly_pct FROM events, q""")


@register("iqr_details")
def iqr_details(spark, d):
    f = eda.iqr_flags(table(spark, d, "events").select(*EV), FEATURES)
    return eda.anomaly_details(f, order_by=EV)


oracle("iqr_details", f"""WITH q AS (SELECT {_iqr_cte('events', FEATURES)} FROM events)
SELECT event_id, user_id, value FROM events, q WHERE {_IQR_FLAG}
ORDER BY event_id, user_id, value""")

_ZM = ", ".join(f"AVG({c}) AS m{i}, STDDEV_POP({c}) AS s{i}, STDDEV_SAMP({c}) AS ss{i}" for i, c in enumerate(FEATURES))
_Z_FLAG = " OR ".join(f"COALESCE(s{i} > 0 AND ABS({c} - m{i}) / s{i} > 3, FALSE)" for i, c in enumerate(FEATURES))


@register("zscore_flag")
def zscore_flag(spark, d):
    return eda.anomaly_summary(eda.zscore_flags(table(spark, d, "events"), FEATURES), "Z-Score")


oracle("zscore_flag", f"""WITH z AS (SELECT {_ZM} FROM events)
SELECT 'Z-Score' AS method, CAST(COUNT(*) FILTER (WHERE {_Z_FLAG}) AS BIGINT) AS anomaly_count,
       ROUND(COUNT(*) FILTER (WHERE {_Z_FLAG}) * 100.0 / COUNT(*), 2) AS anomaly_pct FROM events, z""")


@register("zscore_summary")
def zscore_summary(spark, d):
    return eda.zscore_summary(table(spark, d, "events"), FEATURES)


oracle("zscore_summary", f"""WITH z AS (SELECT {_ZM} FROM events)
""" + _u([f"""SELECT '{c}' AS column_name,
   (SELECT CAST(COUNT(*) AS BIGINT) FROM events WHERE s{i} > 0 AND ABS({c} - m{i}) / s{i} > 3) AS outliers,
   ROUND(m{i} - 3 * ss{i}, 2) AS lower, ROUND(m{i} + 3 * ss{i}, 2) AS upper FROM z"""
          for i, c in enumerate(FEATURES)]))


@register("outlier_summary")
def outlier_summary(spark, d):
    return eda.outlier_summary(table(spark, d, "lineitem"), "l_extendedprice", "iqr")


oracle("outlier_summary", """
WITH q AS (SELECT QUANTILE_CONT(l_extendedprice, 0.25) AS a, QUANTILE_CONT(l_extendedprice, 0.75) AS b,
                  COUNT(l_extendedprice) AS n FROM lineitem),
o AS (SELECT COUNT(*) AS k FROM lineitem, q
      WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a))
SELECT 'iqr' AS method, 'l_extendedprice' AS column_name, CAST(k AS BIGINT) AS outlier_count,
       ROUND(k * 100.0 / n, 2) AS outlier_pct, ROUND(a - 1.5 * (b - a), 2) AS lower,
       ROUND(b + 1.5 * (b - a), 2) AS upper FROM q, o""")


@register("outlier_rows")
def outlier_rows(spark, d):
    return eda.outlier_rows(table(spark, d, "events"), "value", ["event_id"])


oracle("outlier_rows", """
WITH q AS (SELECT QUANTILE_CONT(value, 0.25) AS a, QUANTILE_CONT(value, 0.75) AS b FROM events)
SELECT event_id, value FROM events, q
WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)
ORDER BY event_id, value""")


@register("outlier_summary_z")
def outlier_summary_z(spark, d):
    return eda.outlier_summary(table(spark, d, "events"), "value", "zscore")


oracle("outlier_summary_z", """
WITH z AS (SELECT AVG(value) AS m, STDDEV_POP(value) AS s, STDDEV_SAMP(value) AS ss, COUNT(value) AS n FROM events),
o AS (SELECT COUNT(*) AS k FROM events, z WHERE s > 0 AND ABS(value - m) / s > 3)
SELECT 'zscore' AS method, 'value' AS column_name, CAST(k AS BIGINT) AS outlier_count,
       ROUND(k * 100.0 / n, 2) AS outlier_pct, ROUND(m - 3 * ss, 2) AS lower, ROUND(m + 3 * ss, 2) AS upper
FROM z, o""")


@register("histogram")
def histogram(spark, d):
    return eda.histogram(table(spark, d, "part"), "p_retailprice", 30)


oracle("histogram", """
WITH r AS (SELECT MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi FROM part),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 30 > 0 THEN LEAST(FLOOR((p_retailprice - lo) / ((hi - lo) / 30)), 29)
                  ELSE 0 END AS BIGINT) AS bin
      FROM part, r WHERE p_retailprice IS NOT NULL)
SELECT bin, ROUND(lo + bin * ((hi - lo) / 30), 4) AS lower, ROUND(lo + (bin + 1) * ((hi - lo) / 30), 4) AS upper,
       CAST(COUNT(*) AS BIGINT) AS count FROM b, r GROUP BY bin, lo, hi""")


@register("distribution")
def distribution(spark, d):
    return eda.distribution_stats(table(spark, d, "lineitem"), "l_extendedprice")


oracle("distribution", f"""
SELECT ROUND(AVG(l_extendedprice), 2) AS mean, ROUND(QUANTILE_CONT(l_extendedprice, 0.5), 2) AS median,
       ROUND({_g1('l_extendedprice')}, 2) AS skew, ROUND({_g2('l_extendedprice')}, 2) AS kurtosis FROM lineitem""")


@register("box_stats")
def box_stats(spark, d):
    return eda.box_stats(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")


oracle("box_stats", """
SELECT c_mktsegment, CAST(COUNT(c_acctbal) AS BIGINT) AS count, ROUND(MIN(c_acctbal), 4) AS min,
       ROUND(QUANTILE_CONT(c_acctbal, 0.25), 4) AS q1, ROUND(QUANTILE_CONT(c_acctbal, 0.5), 4) AS median,
       ROUND(QUANTILE_CONT(c_acctbal, 0.75), 4) AS q3, ROUND(MAX(c_acctbal), 4) AS max
FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
