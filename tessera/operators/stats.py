"""Hypothesis tests (H1-H4).

Every statistic is built from aggregates (per-group n / mean / variance,
co-moments, ranks), so the data is never gathered in one place; only the
final p-value is computed by a small pandas UDF over the result row(s).

* t-test / ANOVA: one ``groupBy(group)`` with n, mean, var; the between /
  within sums are an aggregate over the (few) group rows.
* Pearson: ``regr_*`` co-moments over complete pairs.
* Spearman: exact average ranks of the counted pairs from the distributed
  global rank, then Pearson on the ranks, weighted by the counts.
* Shapiro-Wilk (Royston 1995): a seeded hash sample of at most 5000 values
  per column (the test is defined on that sample size), tested per column
  with ``groupBy(column).applyInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col, fixed, safe_corr, strength
from tessera.functions.longform import occurrences, top_k_per_group
from tessera.functions.nulls import normalize_nulls
from tessera.functions.ranks import value_ranks
from tessera.functions.special import f_pvalue, norm_cdf, norm_ppf, t_pvalue
from tessera.session import materialize


# --- Fixed values: texts of the interpretations, which must read alike --------
FEW_GROUPS_TEXT = "Need at least 2 groups with data"
TWO_DIFFER_TEXT = "Significant difference between groups (p=%s)"
TWO_ALIKE_TEXT = "No significant difference between groups (p=%s)"
DIFFERENCE_TEXT = "Significant difference among %d groups (p=%s)"
NO_DIFFERENCE_TEXT = "No significant difference among %d groups (p=%s)"
NOT_NORMAL_TEXT = "'%s' does NOT follow a normal distribution (p=%s)"
NORMAL_TEXT = "'%s' appears normally distributed (p=%s)"
# --- end of fixed values ---------------------------------------------------


def group_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with >= 2 values: two -> pooled two-sample t (first minus
    second in key order), three or more -> one-way ANOVA F; fewer -> 'N/A'.
    Columns: test_name, groups, statistic (4 dp; NULL if no group varies), df1, df2."""
    d = normalize_nulls(df.select(col(group).alias("g"), col(value).cast("double").alias("x")))
    d = d.where(F.col("g").isNotNull() & F.col("x").isNotNull())
    per = d.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    per = per.where(F.col("n") >= 2)
    a = per.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"),
        F.min_by(F.struct("n", "m", "v"), "g").alias("g1"), F.max_by(F.struct("n", "m", "v"), "g").alias("g2"))
    ssb = per.crossJoin(F.broadcast(a.select("gm"))).agg(
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2).alias("ssb"))
    x = a.crossJoin(ssb)
    k, N = F.col("k"), F.col("N")
    sp2 = F.try_divide((F.col("g1.n") - 1) * F.col("g1.v") + (F.col("g2.n") - 1) * F.col("g2.v"), N - 2)
    t = F.try_divide(F.col("g1.m") - F.col("g2.m"), F.sqrt(sp2 * (1 / F.col("g1.n") + 1 / F.col("g2.n"))))
    fstat = F.try_divide(F.try_divide(F.col("ssb"), k - 1), F.try_divide(F.col("ssw"), N - k))
    name = (F.when(k == 2, F.lit("Independent t-test"))
            .when(k >= 3, F.format_string("One-way ANOVA (%d groups)", k)).otherwise(F.lit("N/A")))
    stat = F.when(k == 2, t).when(k >= 3, fstat).otherwise(F.lit(0.0))
    return x.select(name.alias("test_name"), k.cast("long").alias("groups"),
                    F.round(stat, 4).alias("statistic"), stat.alias("_stat"),
                    F.when(k == 2, N - 2).when(k >= 3, k - 1).cast("long").alias("df1"),
                    F.when(k >= 3, N - k).cast("long").alias("df2"))


def group_test_p(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """group_test plus p-value (4 dp), significance and interpretation."""
    g = group_test(df, group, value)
    p = (F.when(F.col("groups") == 2, t_pvalue(F.col("_stat"), F.col("df1").cast("double")))
         .when(F.col("groups") >= 3, f_pvalue(F.col("_stat"), F.col("df1").cast("double"),
                                              F.col("df2").cast("double")))
         .otherwise(F.lit(1.0)))
    g = g.withColumn("p_value", p)
    sig = F.col("p_value") < alpha
    pt = fixed(F.col("p_value"), 4)
    interp = (F.when(F.col("groups") < 2, F.lit(FEW_GROUPS_TEXT))
              .when(F.col("groups") == 2,
                    F.when(sig, F.format_string(TWO_DIFFER_TEXT, pt))
                    .otherwise(F.format_string(TWO_ALIKE_TEXT, pt)))
              .otherwise(F.when(sig, F.format_string(DIFFERENCE_TEXT,
                                                     F.col("groups"), pt))
                         .otherwise(F.format_string(NO_DIFFERENCE_TEXT,
                                                    F.col("groups"), pt))))
    return g.select("test_name", "groups", "statistic", "df1", "df2", F.round("p_value", 4).alias("p_value"),
                    sig.alias("is_significant"), interp.alias("interpretation"), F.lit(alpha).alias("alpha"))


def _corr_result(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return _with_t(pairs.agg(safe_corr(F.col(a), F.col(b)).alias("_r"), F.regr_count(F.col(b), F.col(a)).alias("n")))


def _with_t(x: DataFrame) -> DataFrame:
    t = F.when(F.abs(F.col("_r")) < 1,
               F.col("_r") * F.sqrt((F.col("n") - 2) / (1 - F.col("_r") ** 2)))
    return x.select(F.round("_r", 4).alias("r"), F.col("n").cast("long").alias("n"),
                    F.round(t, 4).alias("t"), "_r", t.alias("_t"))


def pearson_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """r over complete pairs, n, and t = r·√((n−2)/(1−r²))."""
    d = normalize_nulls(df.select(col(a).cast("double").alias("x"), col(b).cast("double").alias("y")))
    return _corr_result(d, "x", "y").select("r", "n", "t")


def _rank_corr(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows are counted per (x, y) first: ranks and co-moments are those of the
    counted pairs, so a pair held by a third of all rows is one row in both joins."""
    d = normalize_nulls(df.select(col(a).cast("double").alias("x"), col(b).cast("double").alias("y")))
    d = d.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = materialize(d.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_cnt")), "pairs")
    rx = value_ranks(pairs, "x", "_cnt").select(F.col("v").alias("x"), F.col("rank_avg").alias("rx"))
    ry = value_ranks(pairs, "y", "_cnt").select(F.col("v").alias("y"), F.col("rank_avg").alias("ry"))
    n = pairs.agg(F.coalesce(F.sum("_cnt"), F.lit(0)).alias("n"))
    centre = (F.col("n") + 1) / 2.0  # the mean of n average ranks
    u, v, w = F.col("rx") - centre, F.col("ry") - centre, F.col("_cnt")
    moments = pairs.join(rx, "x").join(ry, "y").crossJoin(F.broadcast(n)).agg(
        F.sum(w * u * v).alias("xy"), F.sum(w * u * u).alias("xx"), F.sum(w * v * v).alias("yy"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    varies = (F.col("xx") > 0) & (F.col("yy") > 0)
    return _with_t(moments.select(F.when(varies, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("_r"), "n"))


def spearman_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman ρ = Pearson r of the average ranks (complete pairs), n, t."""
    return _rank_corr(df, a, b).select(F.col("r").alias("rho"), "n", "t")


def _with_p(res: DataFrame, name: str, label: str, words: tuple, alpha: float) -> DataFrame:
    p = F.when(F.abs(F.col("_r")) >= 1, F.lit(0.0)).otherwise(t_pvalue(F.col("_t"), (F.col("n") - 2).cast("double")))
    res = res.withColumn("p_value", p)
    sig = F.col("p_value") < alpha
    a = F.abs(F.col("_r"))
    kind = F.when(a >= 0.7, words[0]).when(a >= 0.4, "moderate").otherwise("weak")
    interp = F.format_string(f"{label}=%s: %s %s {words[1]}", fixed(F.col("_r"), 3),
                             F.when(sig, "significant").otherwise("not significant"), kind)
    return res.select(F.lit(name).alias("test_name"), F.col("r").alias("statistic"), "n",
                      F.round("p_value", 4).alias("p_value"), sig.alias("is_significant"),
                      interp.alias("interpretation"), F.lit(alpha).alias("alpha"))


def pearson_test_p(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    d = normalize_nulls(df.select(col(a).cast("double").alias("x"), col(b).cast("double").alias("y")))
    return _with_p(_corr_result(d, "x", "y"), "Pearson Correlation", "Pearson r", ("strong", "correlation"), alpha)


def spearman_test_p(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    return _with_p(_rank_corr(df, a, b), "Spearman Correlation", "Spearman ρ", ("monotonic", "relationship"), alpha)


# ---------------------------------------------------------------- Shapiro-Wilk
# --- Fixed values: Royston (1995) polynomial coefficients -------------------
_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]
_G = [-2.273, 0.459]
# --- end of fixed values ---------------------------------------------------


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p-value of the Shapiro-Wilk test (Royston's approximation)."""
    x = np.sort(np.asarray(x, dtype="float64"))
    n = len(x)
    if n < 3 or x[-1] - x[0] <= 0:
        return float("nan"), float("nan")
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        ssq = float(np.sum(m * m))
        u = 1.0 / math.sqrt(n)
        a = np.zeros(n)
        an = m[-1] / math.sqrt(ssq) + _poly(_C1, u)
        if n > 5:
            an1 = m[-2] / math.sqrt(ssq) + _poly(_C2, u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = an1, -an1
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = an, -an
    xm = x - x.mean()
    w = float(np.dot(a, x) ** 2 / np.dot(xm, xm))
    w = min(w, 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if n <= 11:
        gamma = _poly(_G, n)
        mu = _poly(_C3, n)
        sigma = math.exp(_poly(_C4, n))
        if 1 - w <= 0 or gamma - math.log(1 - w) <= 0:
            return w, 0.0
        z = (-math.log(gamma - math.log(1 - w)) - mu) / sigma
    else:
        ln = math.log(n)
        mu = _poly(_C5, ln)
        sigma = math.exp(_poly(_C6, ln))
        if 1 - w <= 0:
            return w, 1.0
        z = (math.log(1 - w) - mu) / sigma
    return w, 1.0 - norm_cdf(z)


def shapiro(df: DataFrame, cols: list[str], alpha: float = 0.05, max_n: int = 5000,
            seed: int = 42) -> DataFrame:
    """Shapiro-Wilk per column on at most ``max_n`` non-NULL values; when a
    column has more, the sample is the ``max_n`` values with the smallest
    seeded hash of value and number of the copy, so that copies are drawn
    independently (deterministic, salted top-k — no column is ever gathered
    whole). Columns: column_name, n, statistic, p_value, is_significant,
    interpretation."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("double").alias("value")) for c in cols])
    counts = (normalize_nulls(df).select(F.explode(arr).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_cnt")))
    long = occurrences(counts, ["column_name", "value"], "_cnt").withColumn(
        "_h", F.xxhash64(F.lit(seed), "column_name", "value", "_occ"))
    sample = top_k_per_group(long, ["column_name"], [F.col("_h"), F.col("value"), F.col("_occ")], max_n,
                             salt_on=F.col("_h")).select("column_name", "value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame({"column_name": [pdf["column_name"].iloc[0]], "n": [len(pdf)],
                             "statistic": [round(w, 4) if not math.isnan(w) else None],
                             "p_value": [round(p, 4) if not math.isnan(p) else None]})

    res = sample.groupBy("column_name").applyInPandas(
        run, "column_name string, n long, statistic double, p_value double")
    sig = F.col("p_value") < alpha
    interp = F.when(sig, F.format_string(NOT_NORMAL_TEXT,
                                         F.col("column_name"), fixed(F.col("p_value"), 4))) \
              .otherwise(F.format_string(NORMAL_TEXT,
                                         F.col("column_name"), fixed(F.col("p_value"), 4)))
    return res.select("column_name", "n", "statistic", "p_value", sig.alias("is_significant"),
                      interp.alias("interpretation"))

