"""Mergeable column profiles (D11, S19): states that are saved and joined with the states of appended data.

One row per column holds the row and NULL counts, for numbers their sum, least
and greatest value and a KLL sketch (quantiles within about 1.4 % of the ranks
at the default size), an HLL sketch (distinct values within about 1.6 %) and the
most frequent values. All of them merge, so the profile of a table is the merge
of the profiles of its parts, and new data costs one scan of the new data.

Frequent values are kept by at most ``held`` counters per task and column
(space saving, in its form with decrements): a batch's values are counted,
added to the counters, and what is above the limit pays with the count of the
first one over it. Merged counters are cut the same way. A kept count is too
low by at most rows / (held + 1), so a value above that share is never lost;
``error`` says by how much at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import col
from tessera.functions.longform import top_k_per_group
from tessera.functions.nulls import normalize_nulls
from tessera.functions.schema import numeric_cols
from tessera.operators.profile import _bounded

HELD = 1024
LG_K = 12
KLL_K = 200


def _frequent(long: DataFrame, held: int) -> DataFrame:
    """(column_name, value, count, error): the counters of every task. ``error``: what the task took off, at most."""

    def run(it):
        counters: dict[str, pd.Series] = {}
        taken: dict[str, int] = {}
        for pdf in it:
            for name, values in pdf.groupby("column_name")["value"]:
                count = values.value_counts()
                if name in counters:
                    count = counters[name].add(count, fill_value=0)
                if len(count) > held:
                    count = count.sort_values(ascending=False)
                    over = int(count.iloc[held])
                    taken[name] = taken.get(name, 0) + over
                    count = count.iloc[:held] - over
                    count = count[count > 0]
                counters[name] = count
        for name, count in counters.items():
            yield pd.DataFrame({"column_name": name, "value": [*count.index.astype(str), None],
                                "count": [*count.astype(np.int64), 0], "error": [*([0] * len(count)), taken.get(name, 0)]})

    return long.where(F.col("value").isNotNull()).select("column_name", "value").mapInPandas(run, "column_name string, value string, count long, error long")


def _top(counted: DataFrame, held: int) -> DataFrame:
    """(column_name, top, error): counters of all tasks added up and cut to ``held`` for each column."""
    error = counted.groupBy("column_name").agg(F.sum("error").alias("error"))
    sums = counted.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.sum("count").alias("count"))
    best = top_k_per_group(sums, ["column_name"], [F.col("count").desc(), F.col("value")], held + 1, salt_on=F.xxhash64("value"))
    over = F.coalesce(F.max(F.when(F.col("rank") == held + 1, F.col("count"))).over(Window.partitionBy("column_name")), F.lit(0))
    cut = best.withColumn("over", over).withColumn("count", F.col("count") - F.col("over"))
    kept = F.struct(F.col("count"), F.col("value"))
    tops = cut.groupBy("column_name").agg(F.max("over").alias("over"), F.collect_list(F.when(F.col("count") > 0, kept)).alias("top"))
    return error.join(tops, "column_name", "left").select("column_name", F.coalesce("top", F.array().cast("array<struct<count:bigint,value:string>>")).alias("top"),
                                                            (F.col("error") + F.coalesce("over", F.lit(0))).alias("error"))


def profile_state(df: DataFrame, held: int = HELD) -> DataFrame:
    """The mergeable profile of ``df``, a row per column: (column_name, rows, missing, total, least, greatest, kll, hll, top, error).

    Texts beyond 64 characters are known by their beginning and a digest. A
    table without rows gives rows with zeros and empty sketches."""
    d = normalize_nulls(df)
    nums = set(numeric_cols(df))
    text = lambda c: _bounded(col(c).cast("string"))
    number = lambda c: col(c).cast("double") if c in nums else F.lit(None).cast("double")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("value"), number(c).alias("number")) for c in d.columns])
    long = d.select(F.explode(cells).alias("c")).select("c.*")
    facts = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.sum("number").alias("total"), F.min("number").alias("least"),
        F.max("number").alias("greatest"), F.kll_sketch_agg_double("number", KLL_K).alias("kll"), F.hll_sketch_agg("value", LG_K).alias("hll"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position int, column_name string")
    tops = _top(_frequent(long, held), held)
    out = names.join(facts, "column_name", "left").join(tops, "column_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("position", "column_name", zero("rows"), zero("missing"), "total", "least", "greatest", "kll", "hll",
                      F.coalesce("top", F.array().cast("array<struct<count:bigint,value:string>>")).alias("top"), zero("error"))


def merge_states(states: DataFrame, held: int = HELD) -> DataFrame:
    """One state per column from any number of states (rows of one or more ``profile_state`` frames)."""
    facts = states.groupBy("column_name").agg(
        F.min("position").alias("position"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("total").alias("total"), F.min("least").alias("least"),
        F.max("greatest").alias("greatest"), F.kll_merge_agg_double("kll", KLL_K).alias("kll"), F.hll_union_agg("hll").alias("hll"))
    none = F.struct(F.lit(0).cast("long").alias("count"), F.lit(None).cast("string").alias("value"))
    counters = states.select("column_name", F.explode(F.concat(F.array(none), "top")).alias("t"), "error")
    counters = counters.select("column_name", "t.value", "t.count", F.when(F.col("t.value").isNull(), F.col("error")).otherwise(0).alias("error"))
    tops = _top(counters, held)
    return facts.join(tops, "column_name").select("position", "column_name", "rows", "missing", "total", "least", "greatest", "kll", "hll", "top", "error")


def read_state(state: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75), k: int = 5) -> DataFrame:
    """(column_name, rows, missing, distinct, mean, least, greatest, q25, q50, ..., top, error): the figures of a state.

    top: the ``k`` most frequent values as (count, value), ties by value; a count is at most ``error`` too low."""
    known = F.col("rows") - F.col("missing")
    quantile = lambda p: F.when(F.col("total").isNotNull(), F.kll_sketch_get_quantile_double("kll", F.lit(p))).alias(f"q{round(p * 100)}")
    order = F.array_sort("top", lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1).when(a["value"] < b["value"], -1).otherwise(1))
    return state.select("position", "column_name", "rows", "missing", F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0)).alias("distinct"),
                        F.try_divide("total", known).alias("mean"), "least", "greatest", *(quantile(p) for p in probs),
                        F.slice(order, 1, k).alias("top"), "error").orderBy("position").drop("position")
