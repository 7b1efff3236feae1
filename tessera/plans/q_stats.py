"""Hypothesis-test queries (H1-H4)."""

from __future__ import annotations

from tessera.operators import stats as st
from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.views import table

_GROUPS = """per AS (SELECT {g} AS g, COUNT(l_extendedprice) AS n, AVG(l_extendedprice) AS m,
                    VAR_SAMP(l_extendedprice) AS v
             FROM lineitem WHERE {g} IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 2),
a AS (SELECT COUNT(*) AS k, SUM(n) AS bn, SUM(n * m) / SUM(n) AS gm, SUM((n - 1) * v) AS ssw,
             arg_min(n, g) AS n1, arg_min(m, g) AS m1, arg_min(v, g) AS v1,
             arg_max(n, g) AS n2, arg_max(m, g) AS m2, arg_max(v, g) AS v2 FROM per),
b AS (SELECT SUM(n * (m - gm) * (m - gm)) AS ssb FROM per, a)"""


@register("ttest")
def ttest(spark, d):
    return st.group_test(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice").drop("_stat")


oracle("ttest", "WITH " + _GROUPS.format(g="l_linestatus") + """
SELECT 'Independent t-test' AS test_name, CAST(k AS BIGINT) AS groups,
       ROUND((m1 - m2) / SQRT(((n1 - 1) * v1 + (n2 - 1) * v2) / (bn - 2) * (1.0 / n1 + 1.0 / n2)), 4) AS statistic,
       CAST(bn - 2 AS BIGINT) AS df1, CAST(NULL AS BIGINT) AS df2 FROM a""")


@register("anova")
def anova(spark, d):
    return st.group_test(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").drop("_stat")


oracle("anova", "WITH " + _GROUPS.format(g="l_returnflag") + """
SELECT printf('One-way ANOVA (%d groups)', k) AS test_name, CAST(k AS BIGINT) AS groups,
       ROUND((ssb / (k - 1)) / (ssw / (bn - k)), 4) AS statistic,
       CAST(k - 1 AS BIGINT) AS df1, CAST(bn - k AS BIGINT) AS df2 FROM a, b""")


@register("ttest_pvalue")
def ttest_pvalue(spark, d):
    return st.group_test_p(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice")


@register("anova_pvalue")
def anova_pvalue(spark, d):
    return st.group_test_p(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


_PAIR = """SELECT ROUND(r, 4) AS {rn}, CAST(n AS BIGINT) AS n,
       ROUND(CASE WHEN ABS(r) < 1 THEN r * SQRT((n - 2) / (1 - r * r)) END, 4) AS t
FROM (SELECT regr_sxy(y, x) / SQRT(regr_sxx(y, x) * regr_syy(y, x)) AS r, regr_count(y, x) AS n FROM {src})"""


@register("pearson_test")
def pearson_test(spark, d):
    return st.pearson_test(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


oracle("pearson_test", _PAIR.format(
    rn="r", src="(SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem)"))


@register("spearman_test")
def spearman_test(spark, d):
    return st.spearman_test(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


oracle("spearman_test", _PAIR.format(rn="rho", src="""(
  SELECT RANK() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0 AS x,
         RANK() OVER (ORDER BY b) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2.0 AS y
  FROM (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b FROM lineitem
        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL))"""))


@register("pearson_pvalue")
def pearson_pvalue(spark, d):
    return st.pearson_test_p(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@register("spearman_pvalue")
def spearman_pvalue(spark, d):
    return st.spearman_test_p(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@register("shapiro")
def shapiro(spark, d):
    return st.shapiro(table(spark, d, "events"), ["value", "user_id"])
