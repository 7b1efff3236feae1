"""Long ("tidy") forms used for per-value work over many columns at once.

``melt_values`` turns the chosen columns into (column_name, value) rows so a
single ``groupBy(column_name, value)`` yields value counts, distinct counts,
modes and top-k for every column in one shuffle, instead of one job (or one
Expand copy of the data) per column.

``top_k_per_group`` ranks inside groups without funnelling a whole group
through one task: rows are first ranked inside (group, salt) buckets, only the
k best per bucket survive, and the final ranking sees at most k·salts rows per
group. This matters when one group (a column with a billion distinct values,
a hot key) holds a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt_values(df: DataFrame, cols: list[str], as_string: bool = True,
                key: str = "column_name", value: str = "value") -> DataFrame:
    """(column_name, value) for every non-NULL value of ``cols``."""
    def v(c):
        e = F.col(f"`{c}`")
        return e.cast("string") if as_string else e.cast("double")
    arr = F.array(*[F.struct(F.lit(c).alias(key), v(c).alias(value)) for c in cols])
    return (df.select(F.explode(arr).alias("_kv")).select(f"_kv.{key}", f"_kv.{value}")
            .where(F.col(value).isNotNull()))


def value_counts_long(df: DataFrame, cols: list[str], as_string: bool = True) -> DataFrame:
    """(column_name, value, count) — one shuffle for all columns."""
    return (melt_values(df, cols, as_string)
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    tiebreak: list[Column] | None = None, salt_buckets: int = 32,
                    salt_on: Column | None = None, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group with a two-level (salted) ranking.

    ``order`` must be a total order within a group (add a tie-breaker), so the
    result equals a plain ``row_number() <= k`` over the whole group.
    """
    salt_src = salt_on if salt_on is not None else F.xxhash64(*[c for c in order])
    salted = df.withColumn("_salt", F.pmod(salt_src, F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (pre.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
            .drop("_salt", "_r1"))


def occurrences(counts: DataFrame, keys: list[str], count: str, at_once: int = 1024) -> DataFrame:
    """One row per copy of counted rows: ``keys`` and the copy's number ``_occ``
    from 0. A hot row is dealt out in runs of ``at_once`` copies, so that its
    copies are made by many tasks."""
    runs = F.floor((F.col(count) - 1) / at_once).cast("long")
    dealt = counts.select(*keys, count, F.explode(F.sequence(F.lit(0).cast("long"), runs)).alias("_run"))
    dealt = dealt.repartition(*keys, "_run")
    start = F.col("_run") * at_once
    end = F.least(start + at_once, F.col(count)) - 1
    return dealt.select(*keys, F.explode(F.sequence(start, end)).alias("_occ"))


def modes(df: DataFrame, cols: list[str], as_string: bool = True) -> DataFrame:
    """(column_name, mode, mode_count): most frequent non-NULL value per
    column, the smallest value among ties. Counting is a shuffled groupBy and
    the pick is an algebraic ``min(struct)`` — no column's distinct values are
    ever held by one task."""
    counts = value_counts_long(df, cols, as_string)
    best = F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v")))
    return (counts.groupBy("column_name").agg(best.alias("_b"))
            .select("column_name", F.col("_b.v").alias("mode"), (-F.col("_b.nc")).alias("mode_count")))
