"""Distributed global order: ranks, positions and exact quantiles.

A global rank needs the whole value order, and a window with no partitioning
puts every value into one task. One routine serves every size and every caller:

1. rows are counted per distinct value (shuffled groupBy with map-side combine,
   so a value holding a third of all rows is one row with a large count);
2. the counted values are range-partitioned into ``spark.sql.shuffle.partitions``
   runs of about equal size, and the table is written with each row's run to the
   shared folder (range bounds come from a sample, so they must be drawn once);
3. run totals (a row per run and group) give each run's offset;
4. a window within the run gives the count below each value.

The result is exact: the sampled bounds only affect how evenly work is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def with_runs(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """``counts`` plus ``_run``, its place among the range partitions of (group, value)."""
    runs = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(runs, *[F.col(f"`{g}`") for g in group], F.col(f"`{value}`"))
    return materialize(ordered.withColumn("_run", F.spark_partition_id()), "positions")


def running_before(counts: DataFrame, value: str, weight: str, group: list[str] | None = None, total: str | None = None) -> DataFrame:
    """``counts`` (one row per group and value) plus ``before``: the weight of
    all smaller values of the same group, and as ``total`` that of the whole group."""
    group = group or []
    tagged = with_runs(counts, group, value)
    keys = [F.col(f"`{g}`") for g in group]
    zero = F.lit(0).cast(counts.schema[weight].dataType)
    earlier = Window.unboundedPreceding, -1
    totals = tagged.groupBy("_run", *keys).agg(F.sum(weight).alias("_total"))
    whole = [F.sum("_total").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offset = totals.select("_run", *keys, F.coalesce(
        F.sum("_total").over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(*earlier)), zero).alias("_offset"), *whole)
    inside = F.sum(weight).over(Window.partitionBy("_run", *keys).orderBy(F.col(f"`{value}`")).rowsBetween(*earlier))
    joined = tagged.join(offset, ["_run", *group])
    before = (F.col("_offset") + F.coalesce(inside, zero)).alias("before")
    return joined.select(*[F.col(f"`{c}`") for c in counts.columns], before, *([total] if total else []))


def value_positions(df: DataFrame, v: str = "v", w: str | None = None) -> DataFrame:
    """(v, wsum, before): per distinct non-NULL value, its total weight and the
    total weight of all smaller values. ``w`` = None counts rows."""
    src = df.select(F.col(v).alias("v"), (F.col(w) if w else F.lit(1)).cast("double").alias("_w"))
    counts = src.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("_w").alias("wsum"))
    return running_before(counts, "v", "wsum")


def value_ranks(values: DataFrame, col: str = "v", weight: str | None = None) -> DataFrame:
    """(v, cnt, rank_min, rank_avg) for every distinct non-NULL value of
    ``values[col]``. rank_avg is the pandas/scipy 'average' tie rank. A row counts
    ``weight`` times (default: once)."""
    times = F.col(weight) if weight else F.lit(1).cast("long")
    counts = (values.select(F.col(col).alias("v"), times.alias("_w")).where(F.col("v").isNotNull())
              .groupBy("v").agg(F.sum("_w").alias("cnt")))
    return running_before(counts, "v", "cnt").select(
        "v", "cnt", (F.col("before") + 1).cast("long").alias("rank_min"),
        (F.col("before") + (F.col("cnt") + 1) / 2.0).alias("rank_avg"))


def exact_quantiles(df: DataFrame, v: str, probs: list[float], w: str | None = None) -> DataFrame:
    """One row with q0..q{m-1}: exact linearly interpolated quantiles of
    ``df[v]`` (rows weighted by integer ``w`` when given), found by position
    in the distributed value order — no group is held by one task."""
    pos = value_positions(df, v, w)
    n = pos.agg(F.sum("wsum").alias("_n"))
    j = pos.crossJoin(F.broadcast(n))
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * p
        lo, hi = F.floor(h), F.ceil(h)
        covers = lambda x: (F.col("before") <= x) & (x < F.col("before") + F.col("wsum"))
        aggs += [F.max(F.when(covers(lo), F.col("v"))).alias(f"_lo{i}"),
                 F.max(F.when(covers(hi), F.col("v"))).alias(f"_hi{i}"),
                 F.first(h - lo).alias(f"_f{i}")]
    a = j.agg(*aggs)
    return a.select(*[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}")
                      for i in range(len(probs))])
