"""Exploratory statistics.

Plan shape per report: one wide aggregate for all numeric columns (moments,
min/max, quantiles, pairwise co-moments), bounds applied back to the rows
through a broadcast one-row frame (never collect-then-filter), value counts
and modes through the long form (one shuffle for all columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from tessera.functions.colstats import (comoments, corr_matrix_np, group_quantiles, grouped_positions, long_counts,
                                        moments_of_counts, quantile_row)
from tessera.functions.exprs import col, fixed, sample_kurt, sample_skew, sql_round, stack_rows, strength
from tessera.functions.longform import top_k_per_group, value_counts_long
from tessera.functions.nulls import normalize_nulls
from tessera.functions.schema import categorical_cols, numeric_cols
from tessera.session import materialize, stage_input

QUARTILES = [0.25, 0.75]

# --- Fixed values: texts of the findings, which must read alike ----------------
SKEW_TEXT = "'%s' is highly skewed to the %s (%s)"
OUTLIERS_TEXT = "'%s' has %d outliers (%s%%)"
CORRELATION_TEXT = "Strong correlation between '%s' and '%s' (%s)"
# --- end of fixed values ---------------------------------------------------


def _dbl(df: DataFrame, cols: list[str]) -> DataFrame:
    return normalize_nulls(df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))


def iqr_bounds_wide(d: DataFrame, n: int, k: float = 1.5, approx: bool = False) -> DataFrame:
    """One row: q1_i, q3_i, lo_i, hi_i for columns c0..c{n-1} of ``d``
    (exact quartiles from the distributed positions, or sketched ones)."""
    q = quantile_row(d, [f"c{i}" for i in range(n)], QUARTILES, approx)
    sel = []
    for i in range(n):
        q1, q3 = F.col(f"q{i}_0"), F.col(f"q{i}_1")
        sel += [q1.alias(f"q1_{i}"), q3.alias(f"q3_{i}"),
                (q1 - k * (q3 - q1)).alias(f"lo{i}"), (q3 + k * (q3 - q1)).alias(f"hi{i}")]
    return q.select(*sel)


def univariate(df: DataFrame, cols: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Per numeric column: count, mean, median, mode, std, variance, skewness,
    kurtosis (bias-corrected), min, max, Q1, Q3, IQR and the IQR outlier
    count; NULLs dropped, an empty column reports zeros, and what too few values
    leave undefined (std below 2, skewness below 3, kurtosis below 4) is NULL.

    Eager report operator (k result rows): one scan counts the values of all
    columns, their positions are written once, and moments (merged central
    moments), quartiles, mode and outliers are read from that table."""
    cols = cols or numeric_cols(df)
    k = len(cols)
    pos = materialize(grouped_positions(long_counts(_dbl(df, cols), [f"c{i}" for i in range(k)])), "univariate")
    none = dict.fromkeys(("n", "mean", "var", "std", "skew", "kurt", "min", "max"))
    mom = moments_of_counts(pos)
    sizes = df.sparkSession.createDataFrame([(c, m["n"]) for c, m in mom.items()], "column_name string, _n long")
    j = pos.join(F.broadcast(sizes), "column_name")
    aggs = [F.min(F.struct((-F.col("cnt")).alias("nc"), F.col("value").alias("v"))).getField("v").alias("mode")]
    for i, p_ in enumerate([0.25, 0.5, 0.75]):
        h = (F.col("_n") - 1) * p_
        lo, hi = F.floor(h), F.ceil(h)
        cov = lambda x: (F.col("before") <= x) & (x < F.col("before") + F.col("cnt"))
        aggs += [F.max(F.when(cov(lo), F.col("value"))).alias(f"_lo{i}"),
                 F.max(F.when(cov(hi), F.col("value"))).alias(f"_hi{i}"), F.first(h - lo).alias(f"_f{i}")]
    qrows = {r["column_name"]: r for r in j.groupBy("column_name").agg(*aggs).collect()}  # k rows
    qv = {}
    for c, r in qrows.items():
        qv[c] = [r[f"_lo{i}"] + r[f"_f{i}"] * (r[f"_hi{i}"] - r[f"_lo{i}"]) for i in range(3)]
    bounds = [(c, v[0] - 1.5 * (v[2] - v[0]), v[2] + 1.5 * (v[2] - v[0])) for c, v in qv.items()]
    bdf = df.sparkSession.createDataFrame(bounds, "column_name string, _lo double, _hi double")
    outl = {r["column_name"]: r["o"] for r in pos.join(F.broadcast(bdf), "column_name").groupBy("column_name").agg(
        F.sum(F.when((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi")), F.col("cnt"))
              .otherwise(0)).alias("o")).collect()}
    rnd = lambda v, n: sql_round(float(v), digits) if v is not None else (None if n else 0.0)
    rows = []
    for i, c in enumerate(cols):
        key = f"c{i}"
        m = mom.get(key, none)
        q = qv.get(key, [None, None, None])
        iqr = (q[2] - q[0]) if q[0] is not None else None
        r = lambda v, n=int(m["n"] or 0): rnd(v, n)
        rows.append((c, int(m["n"] or 0), r(m["mean"]), r(q[1]), r(m["std"]), r(m["var"]), r(m["skew"]), r(m["kurt"]), r(m["min"]), r(m["max"]),
                     r(q[0]), r(q[2]), r(iqr), int(outl.get(key) or 0), qrows[key]["mode"] if key in qrows else None))
    schema = ("column_name string, count long, mean double, median double, std double, variance double, "
              "skewness double, kurtosis double, min double, max double, q1 double, q3 double, iqr double, "
              "outlier_count long, mode double")
    return df.sparkSession.createDataFrame(rows, schema)


def corr_long(df: DataFrame, cols: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Pairwise-complete Pearson r for every pair of numeric columns, as
    (col1, col2, i, j, correlation); NULL where a column is constant.

    Co-moment matrices are built per Arrow batch with numpy and summed by
    Spark (O(d²) numbers per partition); only the d×d result reaches the
    driver, whatever the row count."""
    cols = cols or numeric_cols(df)
    k = len(cols)
    d = _dbl(df, cols)
    st = d.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)],
               *[(F.min(f"c{i}") == F.max(f"c{i}")).alias(f"k{i}") for i in range(k)]).first()
    shift = [float(st[f"m{i}"]) if st[f"m{i}"] is not None else 0.0 for i in range(k)]
    r = corr_matrix_np(comoments(d, k, shift))
    for i in range(k):
        if st[f"k{i}"] is None or st[f"k{i}"]:
            r[i, :] = np.nan
            r[:, i] = np.nan
    rows = []
    for i in range(k):
        for j in range(k):
            v = r[min(i, j), max(i, j)]
            v = None if np.isnan(v) else (1.0 if i == j else sql_round(float(v), digits))
            rows.append((cols[i], cols[j], i, j, v))
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, i int, j int, correlation double")


def corr_matrix(df: DataFrame, cols: list[str] | None = None, digits: int = 4) -> DataFrame:
    return corr_long(df, cols, digits).select("col1", "col2", "correlation")


def top_correlations(df: DataFrame, n: int = 10, cols: list[str] | None = None) -> DataFrame:
    """Unique pairs (upper triangle) by |r| descending; ties keep column order."""
    c = corr_long(df, cols).where(F.col("i") < F.col("j"))
    return (c.orderBy(F.abs("correlation").desc_nulls_last(), "i", "j").limit(int(n))
            .select("col1", "col2", "correlation", strength(F.col("correlation")).alias("strength")))


def categorical_summary(df: DataFrame, max_cols: int | None = None, k: int = 5) -> DataFrame:
    """For all text columns, or the first ``max_cols``: distinct count, non-NULL count
    and the top-k values with counts (rank 1 = top value). One shuffle of
    the long form for all columns."""
    cols = categorical_cols(df)[:max_cols]
    counts = value_counts_long(df, cols)
    # summing `count` keeps both branches on the same aggregate, so they share one exchange
    uniq = counts.groupBy("column_name").agg(F.count(F.lit(1)).cast("long").alias("unique"),
                                             F.sum("count").cast("long").alias("non_null"))
    top = top_k_per_group(counts, ["column_name"], [F.col("count").desc(), F.col("value")], k,
                          salt_on=F.xxhash64("value"))
    return top.join(F.broadcast(uniq), "column_name").select(
        "column_name", "unique", "non_null", F.col("rank").cast("long").alias("rank"), "value",
        F.col("count").cast("long").alias("count"))


def eda_insights(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Text findings: |skew| > 1, columns with IQR outliers, strong pairs
    among the top-3 correlations. Columns: kind, column_name, message."""
    cols = cols or numeric_cols(df)
    u = univariate(df, cols)
    skew = u.where(F.abs("skewness") > 1).select(
        F.lit("skew").alias("kind"), "column_name",
        F.format_string(SKEW_TEXT, F.col("column_name"),
                        F.when(F.col("skewness") > 0, "right").otherwise("left"),
                        fixed(F.col("skewness"), 2)).alias("message"))
    outl = u.where(F.col("outlier_count") > 0).select(
        F.lit("outliers").alias("kind"), "column_name",
        F.format_string(OUTLIERS_TEXT, F.col("column_name"), F.col("outlier_count"),
                        fixed(F.try_divide(F.col("outlier_count") * 100.0, F.col("count")), 1)).alias("message"))
    top3 = top_correlations(df, 3, cols).where(F.col("strength") == "strong").select(
        F.lit("correlation").alias("kind"), F.concat_ws("|", "col1", "col2").alias("column_name"),
        F.format_string(CORRELATION_TEXT, F.col("col1"), F.col("col2"),
                        fixed(F.col("correlation"), 3)).alias("message"))
    return skew.unionByName(outl).unionByName(top3)


def iqr_bounds(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Per column: Q1, Q3, lower/upper fence (2 dp) and outlier count."""
    d = _dbl(df, cols)
    b = iqr_bounds_wide(d, len(cols), approx=approx)
    cnt = d.crossJoin(F.broadcast(b)).agg(
        *[F.count_if((F.col(f"c{i}") < F.col(f"lo{i}")) | (F.col(f"c{i}") > F.col(f"hi{i}"))).alias(f"o{i}")
          for i in range(len(cols))])
    wide = b.crossJoin(cnt)
    rows = [(c, {"q1": F.round(F.col(f"q1_{i}"), 4), "q3": F.round(F.col(f"q3_{i}"), 4),
                 "lower": F.round(F.col(f"lo{i}"), 2), "upper": F.round(F.col(f"hi{i}"), 2),
                 "outliers": F.col(f"o{i}").cast("long")}) for i, c in enumerate(cols)]
    return stack_rows(wide, rows)


def iqr_flags(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """``df`` plus ``is_anomaly``: any column outside its IQR fences (NULLs
    never flag). Bounds reach the rows as a broadcast one-row frame."""
    d = normalize_nulls(df)
    b = iqr_bounds_wide(_dbl(df, cols), len(cols), approx=approx)
    flag = F.lit(False)
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        flag = flag | F.coalesce((x < F.col(f"lo{i}")) | (x > F.col(f"hi{i}")), F.lit(False))
    return d.crossJoin(F.broadcast(b)).select(*[col(c) for c in d.columns], flag.alias("is_anomaly"))


def zscore_flags(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    """``df`` plus ``is_anomaly``: |x − mean| / σ > threshold in any column,
    σ the population std (ddof 0); a constant column flags nothing."""
    d = normalize_nulls(df)
    x = _dbl(df, cols)
    m = x.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(cols))],
              *[F.stddev_pop(f"c{i}").alias(f"s{i}") for i in range(len(cols))])
    flag = F.lit(False)
    for i, c in enumerate(cols):
        z = F.try_divide(F.abs(col(c).cast("double") - F.col(f"m{i}")), F.col(f"s{i}"))
        flag = flag | F.coalesce((F.col(f"s{i}") > 0) & (z > threshold), F.lit(False))
    return d.crossJoin(F.broadcast(m)).select(*[col(c) for c in d.columns], flag.alias("is_anomaly"))


def zscore_summary(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    """Per column: outliers (|z| > threshold, ddof 0) and the displayed
    bounds mean ± 3·s with s the sample std (2 dp)."""
    x = _dbl(df, cols)
    m = x.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(cols))],
              *[F.stddev_pop(f"c{i}").alias(f"s{i}") for i in range(len(cols))],
              *[F.stddev_samp(f"c{i}").alias(f"ss{i}") for i in range(len(cols))])
    cnt = x.crossJoin(F.broadcast(m)).agg(*[
        F.count_if((F.col(f"s{i}") > 0) & (F.abs(F.col(f"c{i}") - F.col(f"m{i}")) / F.col(f"s{i}") > threshold))
        .alias(f"o{i}") for i in range(len(cols))])
    wide = m.crossJoin(cnt)
    rows = [(c, {"outliers": F.col(f"o{i}").cast("long"),
                 "lower": F.round(F.col(f"m{i}") - 3 * F.col(f"ss{i}"), 2),
                 "upper": F.round(F.col(f"m{i}") + 3 * F.col(f"ss{i}"), 2)}) for i, c in enumerate(cols)]
    return stack_rows(wide, rows)


def anomaly_summary(flagged: DataFrame, method: str) -> DataFrame:
    """(method, anomaly_count, anomaly_pct of all rows, 2 dp)."""
    return flagged.agg(F.lit(method).alias("method"),
                       F.count_if("is_anomaly").cast("long").alias("anomaly_count"),
                       F.round(F.try_divide(F.count_if("is_anomaly") * 100.0, F.count(F.lit(1))), 2)
                       .alias("anomaly_pct"))


def anomaly_details(flagged: DataFrame, n: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The flagged rows in an explicit key order; all of them, or the first n."""
    keys = order_by or [c for c in flagged.columns if c != "is_anomaly"]
    out = flagged.where("is_anomaly").drop("is_anomaly").orderBy(*[col(k) for k in keys])
    return out if n is None else out.limit(int(n))


def outlier_summary(df: DataFrame, c: str, method: str = "iqr") -> DataFrame:
    """Single column: outlier count, % of non-NULL values, bounds (2 dp)."""
    x = _dbl(df, [c])
    if method == "zscore":
        s = zscore_summary(df, [c])
    else:
        s = iqr_bounds(df, [c])
    n = x.agg(F.count("c0").alias("_n"))
    return s.crossJoin(n).select(
        F.lit(method).alias("method"), "column_name", F.col("outliers").alias("outlier_count"),
        F.round(F.try_divide(F.col("outliers") * 100.0, F.col("_n")), 2).alias("outlier_pct"),
        "lower", "upper")


def outlier_rows(df: DataFrame, c: str, key: list[str], method: str = "iqr", n: int | None = None) -> DataFrame:
    """The outlying rows (key, value) by key; all of them, or the first n."""
    sub = df.select(*[col(k) for k in key], col(c))
    f = zscore_flags(sub, [c]) if method == "zscore" else iqr_flags(sub, [c])
    out = f.where(F.col("is_anomaly") & col(c).isNotNull()).drop("is_anomaly").orderBy(*[col(k) for k in key], col(c))
    return out if n is None else out.limit(int(n))


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max]: (bin, lower, upper, count); the
    max falls in the last bin. A constant column is one bin."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    x = _dbl(df, [c]).where(F.col("c0").isNotNull())
    r = x.agg(F.min("c0").alias("_lo"), F.max("c0").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w > 0, F.least(F.floor((F.col("c0") - F.col("_lo")) / w), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = (x.crossJoin(F.broadcast(r)).groupBy(b.cast("long").alias("bin"))
               .agg(F.count(F.lit(1)).cast("long").alias("count")))
    return counted.crossJoin(F.broadcast(r)).select(
        "bin", F.round(F.col("_lo") + F.col("bin") * w, 4).alias("lower"),
        F.round(F.col("_lo") + (F.col("bin") + 1) * w, 4).alias("upper"), "count")


def distribution_stats(df: DataFrame, c: str) -> DataFrame:
    x = _dbl(df, [c])
    a = x.agg(F.round(F.avg("c0"), 2).alias("mean"), F.round(sample_skew(F.col("c0")), 2).alias("skew"),
              F.round(sample_kurt(F.col("c0")), 2).alias("kurtosis"))
    med = quantile_row(x, ["c0"], [0.5])
    return a.crossJoin(med).select("mean", F.round("q0_0", 2).alias("median"), "skew", "kurtosis")


def box_stats(df: DataFrame, num: str, by: str | None = None) -> DataFrame:
    """Five-number summary (exact quartiles) per group, or overall. Quartiles
    come from the distributed per-group positions, so a group holding a
    third of all rows is never sorted or hashed in one task."""
    key = by or "_all"
    d = normalize_nulls(df.select((col(by) if by else F.lit("all")).alias(key), col(num).cast("double").alias("_v")))
    d = d.where(F.col("_v").isNotNull() & F.col(key).isNotNull())
    q = group_quantiles(d, key, "_v", [0.25, 0.5, 0.75])
    g = d.groupBy(key).agg(F.count("_v").cast("long").alias("count"), F.min("_v").alias("min"),
                           F.max("_v").alias("max"))
    out = g.join(q, key)
    return out.select(*([col(key)] if by else []), "count", F.round("min", 4).alias("min"),
                      F.round("q0", 4).alias("q1"), F.round("q1", 4).alias("median"),
                      F.round("q2", 4).alias("q3"), F.round("max", 4).alias("max"))
