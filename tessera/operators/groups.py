"""Grouped aggregates, top-k and comparison answers (D1, D2, D7, D24, D25,
D28, G1-G5).

Every grouped answer is ``groupBy(key).agg(...)``: a partial aggregate runs on
each partition before the shuffle, so a hot key (even a third of all rows)
reaches the reducer as one pre-aggregated row per partition. Ordering is done
last, on the aggregated rows, with a full tie-breaker (value, then key).
NULL keys are dropped, as a pandas ``groupby`` does; the sum of an all-NULL
group is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col
from tessera.functions.nulls import normalize_nulls
from tessera.functions.colstats import quantile_row


def _grouped(df: DataFrame, cat: str, num: str) -> DataFrame:
    d = normalize_nulls(df.select(col(cat).alias(cat), col(num).cast("double").alias("_v")))
    return d.where(F.col(f"`{cat}`").isNotNull())


def group_agg(df: DataFrame, cat: str, num: str, how: str = "sum") -> DataFrame:
    """(cat, value) with value = sum / mean / count of ``num`` per category,
    sorted by value descending (bar-chart data)."""
    g = _grouped(df, cat, num).groupBy(col(cat))
    if how == "sum":
        out = g.agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"))
    elif how == "mean":
        out = g.agg(F.avg("_v").alias("value"))
    elif how == "count":
        out = g.agg(F.count("_v").cast("double").alias("value"))
    else:
        raise ValueError(f"unknown aggregate {how!r}")
    out = out.select(col(cat), F.round("value", 4).alias("value"))
    return out.orderBy(F.col("value").desc_nulls_last(), col(cat))


def compare(df: DataFrame, cat: str, num: str) -> DataFrame:
    """sum, mean and count of ``num`` per category, 2 dp."""
    return (_grouped(df, cat, num).groupBy(col(cat))
            .agg(F.round(F.coalesce(F.sum("_v"), F.lit(0.0)), 2).alias("sum"),
                 F.round(F.avg("_v"), 2).alias("mean"),
                 F.count("_v").cast("long").alias("count")))


def _top(df: DataFrame, cat: str, num: str, n: int, desc: bool) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    sums = _grouped(df, cat, num).groupBy(col(cat)).agg(
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"))
    order = F.col("value").desc() if desc else F.col("value").asc()
    ranked = sums.orderBy(order, col(cat)).limit(int(n))
    return ranked.select(col(cat), F.round("value", 2).alias("value"))


def top_n(df: DataFrame, cat: str, num: str, n: int = 5) -> DataFrame:
    """Largest n category sums; ties go to the smaller key."""
    return _top(df, cat, num, n, True)


def bottom_n(df: DataFrame, cat: str, num: str, n: int = 5) -> DataFrame:
    return _top(df, cat, num, n, False)


def top_rows(df: DataFrame, num: str, n: int = 10, max_cols: int | None = None) -> DataFrame:
    """Whole rows with the largest ``num``; all columns, or the first ``max_cols``."""
    keep = df.columns[:max_cols]
    if num not in keep:
        keep = keep + [num]
    d = normalize_nulls(df.select(*[col(c) for c in keep]))
    return d.orderBy(col(num).desc_nulls_last(), *[col(c) for c in keep]).limit(int(n))


def best_by(df: DataFrame, cat: str, num: str) -> DataFrame:
    """Category with the largest sum (idxmax) and that sum."""
    sums = _grouped(df, cat, num).groupBy(col(cat)).agg(
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"))
    best = sums.orderBy(F.col("value").desc(), col(cat)).limit(1)
    return best.select(col(cat).cast("string").alias("best"), F.round("value", 2).alias("value"))


def share_of_total(df: DataFrame, cat: str, num: str, n: int | None = 6) -> DataFrame:
    """Top-n category sums (all when n is None) and their share of the grand
    total in % (pie / donut / treemap data)."""
    sums = _grouped(df, cat, num).groupBy(col(cat)).agg(
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"))
    total = sums.agg(F.sum("value").alias("_total"))
    ranked = sums.orderBy(F.col("value").desc(), col(cat))
    if n is not None:
        ranked = ranked.limit(max(1, int(n)))
    out = ranked.crossJoin(F.broadcast(total)).select(
        col(cat), F.round("value", 2).alias("value"),
        F.round(F.try_divide(F.col("value") * 100, F.col("_total")), 4).alias("share_pct"))
    return out.orderBy(F.col("value").desc(), col(cat))


def value_counts(df: DataFrame, c: str, n: int | None = None) -> DataFrame:
    """Counts per non-NULL value, count desc then value asc; ``pct`` is the
    share of *all* rows (NULLs included in the denominator)."""
    d = df.select(col(c).alias("value"))
    total = d.agg(F.count(F.lit(1)).alias("_rows"))
    counts = d.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    ranked = counts.orderBy(F.col("count").desc(), F.col("value"))
    if n is not None:
        ranked = ranked.limit(int(n))
    out = ranked.crossJoin(F.broadcast(total)).select(
        F.col("value").cast("string").alias("value"), F.col("count").cast("long"),
        F.round(F.col("count") * 100.0 / F.col("_rows"), 4).alias("pct"))
    return out.orderBy(F.col("count").desc(), F.col("value"))  # order last: joins do not keep it


def totals(df: DataFrame, c: str) -> DataFrame:
    """Total and average of one numeric column; ``count`` counts all rows."""
    d = normalize_nulls(df.select(col(c).cast("double").alias("_v")))
    return d.agg(F.round(F.coalesce(F.sum("_v"), F.lit(0.0)), 2).alias("total"),
                 F.round(F.avg("_v"), 2).alias("average"),
                 F.count(F.lit(1)).cast("long").alias("count"))


def average(df: DataFrame, c: str) -> DataFrame:
    """Mean, median and sample std of one numeric column, 2 dp."""
    d = normalize_nulls(df.select(col(c).cast("double").alias("_v")))
    a = d.agg(F.round(F.avg("_v"), 2).alias("mean"), F.round(F.stddev_samp("_v"), 2).alias("std"))
    med = quantile_row(d, ["_v"], [0.5])
    return a.crossJoin(med).select("mean", F.round("q0_0", 2).alias("median"), "std")


def average_by(df: DataFrame, num: str, cat: str) -> DataFrame:
    return (_grouped(df, cat, num).groupBy(col(cat))
            .agg(F.round(F.avg("_v"), 2).alias("mean")))


def preview(df: DataFrame, n: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """First n rows in an explicit order (Spark rows have no position)."""
    keys = order_by or df.columns
    return df.orderBy(*[col(k) for k in keys]).limit(int(n))


def numeric_summary(df: DataFrame, c: str) -> DataFrame:
    """Numeric column answer: mean, median, std, min, max, sum (2 dp)."""
    d = normalize_nulls(df.select(col(c).cast("double").alias("_v")))
    a = d.agg(F.round(F.avg("_v"), 2).alias("mean"), F.round(F.stddev_samp("_v"), 2).alias("std"),
              F.round(F.min("_v"), 2).alias("min"), F.round(F.max("_v"), 2).alias("max"),
              F.round(F.coalesce(F.sum("_v"), F.lit(0.0)), 2).alias("sum"))
    med = quantile_row(d, ["_v"], [0.5])
    return a.crossJoin(med).select("mean", F.round("q0_0", 2).alias("median"), "std", "min", "max", "sum")


def categorical_answer(df: DataFrame, c: str, n: int = 5) -> DataFrame:
    """Text column answer: distinct count, mode and the top-n values, as one
    row per top value with the column-level figures repeated."""
    counts = (df.select(col(c).alias("value")).where(F.col("value").isNotNull())
              .groupBy("value").agg(F.count(F.lit(1)).alias("count")))
    summary = counts.agg(F.count(F.lit(1)).cast("long").alias("unique"),
                         F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v")))
                         .getField("v").cast("string").alias("mode"))
    top = counts.orderBy(F.col("count").desc(), F.col("value")).limit(int(n))
    return top.crossJoin(F.broadcast(summary)).select(
        "unique", "mode", F.col("value").cast("string").alias("value"), F.col("count").cast("long")) \
        .orderBy(F.col("count").desc(), F.col("value"))


def scatter_bins(df: DataFrame, x: str, y: str, color: str | None = None, bins: int = 50) -> DataFrame:
    """Data of a scatter chart from every row: (x_bin, y_bin, *color, count) on
    an equal-width grid over the ranges of x and y, the maximum in the last bin;
    a constant axis is one bin. Rows without x or y are left out."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    colors = [color] if color else []
    d = normalize_nulls(df.select(col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y"), *[col(c) for c in colors]))
    d = d.dropna(subset=["_x", "_y"])
    r = d.agg(*[f(c).alias(f"{c}{n}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))])

    def place(c: str):
        share = F.try_divide(F.col(c) - F.col(f"{c}lo"), F.col(f"{c}hi") - F.col(f"{c}lo"))
        return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long")

    return (d.crossJoin(F.broadcast(r)).groupBy(place("_x").alias("x_bin"), place("_y").alias("y_bin"), *[col(c) for c in colors])
            .agg(F.count(F.lit(1)).cast("long").alias("count")))
