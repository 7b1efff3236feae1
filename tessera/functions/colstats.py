"""Scalable per-column statistics shared by the profiling / EDA operators.

* ``moments_of_counts``: count, mean, variance, skewness, kurtosis, min, max
  of counted values: central moments per Arrow batch, merged pairwise.
* ``long_counts`` + ``grouped_quantiles``: exact linear-interpolated
  quantiles for many columns (or many groups) from ONE shuffle of
  (group, value) -> count, positions from the range-partitioned order. No task ever
  holds all distinct values of a column (unlike ``percentile``'s hash map),
  and a value repeated by a third of all rows is a single counted row.
* ``comoments``: pairwise-complete co-moment matrices per Arrow batch with
  numpy (X^T X with NULL masks), summed by one small Spark aggregate — the
  work per row is O(d^2) flops, the shuffle is O(d^2) numbers per partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import running_before


def _merged(n, mean, m2, m3, m4, by, size):
    """Central moments (n, mean, m2, m3, m4) of parts merged by their group number."""
    total = np.bincount(by, n, size)
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = np.bincount(by, n * mean, size) / total
    d = mean - np.nan_to_num(centre)[by]
    return (total, centre, np.bincount(by, m2 + n * d * d, size), np.bincount(by, m3 + 3 * d * m2 + n * d ** 3, size),
            np.bincount(by, m4 + 4 * d * m3 + 6 * d * d * m2 + n * d ** 4, size))


def moments_of_counts(counts: DataFrame, group: str = "column_name") -> dict[str, dict]:
    """Per group of (group, value, cnt): n, mean, var, std, skew (G1), kurt (G2), min, max in one pass.

    Central moments up to the fourth are built per Arrow batch about the batch's
    own mean and merged about the common one, batch by batch, task by task: no
    pass for the mean, no cancellation of power sums. A task sends a row per
    group; the driver gets a row per group and task."""

    def partial(it):
        held = None
        for pdf in it:
            names, by = np.unique(pdf["g"].to_numpy(dtype=object).astype(str), return_inverse=True)
            v, n, k = pdf["value"].to_numpy(dtype="float64"), pdf["cnt"].to_numpy(dtype="float64"), len(names)
            zero = np.zeros(len(v))
            part = pd.DataFrame(dict(zip(("n", "mean", "m2", "m3", "m4"), _merged(n, v, zero, zero, zero, by, k)), g=names))
            ends = pd.Series(v).groupby(by)
            part["lo"], part["hi"] = ends.min().to_numpy(), ends.max().to_numpy()
            held = part if held is None else _together(pd.concat([held, part], ignore_index=True))
        if held is not None:
            yield held[["g", "n", "mean", "m2", "m3", "m4", "lo", "hi"]]

    def _together(parts):
        names, by = np.unique(parts["g"].to_numpy(dtype=object).astype(str), return_inverse=True)
        out = pd.DataFrame(dict(zip(("n", "mean", "m2", "m3", "m4"), _merged(*(parts[c].to_numpy() for c in ("n", "mean", "m2", "m3", "m4")), by, len(names))), g=names))
        ends = parts.groupby(by)
        out["lo"], out["hi"] = ends["lo"].min().to_numpy(), ends["hi"].max().to_numpy()
        return out

    rows = counts.select(F.col(group).alias("g"), F.col("value").cast("double").alias("value"), "cnt").mapInPandas(
        partial, "g string, n double, mean double, m2 double, m3 double, m4 double, lo double, hi double").collect()
    if not rows:
        return {}
    found = _together(pd.DataFrame([r.asDict() for r in rows]))
    return {r.g: _shape(int(r.n), r.mean, r.m2 / r.n, r.m3 / r.n, r.m4 / r.n, r.lo, r.hi) for r in found.itertuples()}


def _shape(n, mean, m2, m3, m4, lo, hi) -> dict:
    st = {"n": n, "mean": float(mean), "var": None, "std": None, "skew": None, "kurt": None, "min": float(lo), "max": float(hi)}
    if n > 1:
        st["var"] = float(m2 * n / (n - 1))
        st["std"] = float(np.sqrt(st["var"]))
    const = m2 <= 1e-300 or hi == lo
    if n >= 3:
        st["skew"] = 0.0 if const else float((m3 / m2 ** 1.5) * np.sqrt(n * (n - 1)) / (n - 2))
    if n >= 4:
        st["kurt"] = 0.0 if const else float((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6))
    return st


def long_counts(df: DataFrame, cols: list[str], as_double: bool = True) -> DataFrame:
    """(column_name, value, cnt) over the non-NULL values of ``cols``: one
    shuffle, map-side combined."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             (F.col(f"`{c}`").cast("double") if as_double else F.col(f"`{c}`").cast("string"))
                             .alias("value")) for c in cols])
    long = df.select(F.explode(arr).alias("kv")).select("kv.column_name", "kv.value")
    if as_double:
        long = long.where(~F.isnan("value"))
    return long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def grouped_positions(counts: DataFrame, group: str = "column_name") -> DataFrame:
    """(group, value, cnt, before): adds the total count of smaller values in
    the same group, from the range-partitioned order of all groups together —
    no group is sorted in one task, however many values it has."""
    return running_before(counts.select(group, "value", "cnt"), "value", "cnt", [group])


def grouped_quantiles(counts: DataFrame, probs: list[float], group: str = "column_name") -> DataFrame:
    """(group, q0..q{m-1}): exact linearly interpolated quantiles per group.

    Every position carries its group's size: a join by group would deal a whole group to one task."""
    return quantiles_of_positions(running_before(counts.select(group, "value", "cnt"), "value", "cnt", [group], "_n"), probs, group)


def quantiles_of_positions(pos: DataFrame, probs: list[float], group: str = "column_name") -> DataFrame:
    """``grouped_quantiles`` from positions with their group's size (group, value, cnt, before, _n)."""
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * p
        lo, hi = F.floor(h), F.ceil(h)
        cov = lambda x: (F.col("before") <= x) & (x < F.col("before") + F.col("cnt"))
        aggs += [F.max(F.when(cov(lo), F.col("value"))).alias(f"_lo{i}"),
                 F.max(F.when(cov(hi), F.col("value"))).alias(f"_hi{i}"), F.first(h - lo).alias(f"_f{i}")]
    a = pos.groupBy(group).agg(*aggs)
    return a.select(group, *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
                             .alias(f"q{i}") for i in range(len(probs))])


def comoments(d: DataFrame, k: int, shift: list[float]) -> dict[str, np.ndarray]:
    """Pairwise-complete sums for double columns c0..c{k-1}:
    n[i,j], sa[i,j] = Σ x_i (rows where x_j non-NULL), saa[i,j] = Σ x_i²
    (same rows), sab[i,j] = Σ x_i x_j (both non-NULL); on shifted values."""
    names = [f"c{i}" for i in range(k)]
    sh = np.asarray(shift, dtype="float64")

    def partial(it):
        acc = None
        for pdf in it:
            x = pdf[names].to_numpy(dtype="float64") - sh
            m = ~np.isnan(x)
            z = np.where(m, x, 0.0)
            mf = m.astype("float64")
            part = np.concatenate([(mf.T @ mf).ravel(), (z.T @ mf).ravel(), ((z * z).T @ mf).ravel(),
                                   (z.T @ z).ravel()])
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"pos": np.arange(len(acc)), "v": acc})

    parts = d.select(*names).mapInPandas(partial, "pos long, v double")
    tot = parts.groupBy("pos").agg(F.sum("v").alias("v")).collect()  # 4·k² numbers, independent of rows
    vec = np.zeros(4 * k * k)
    for r in tot:
        vec[r["pos"]] = r["v"]
    n, sa, saa, sab = (vec[i * k * k:(i + 1) * k * k].reshape(k, k) for i in range(4))
    return {"n": n, "sa": sa, "saa": saa, "sab": sab}


def corr_matrix_np(mom: dict[str, np.ndarray]) -> np.ndarray:
    """Pearson r[i,j] over rows where both are non-NULL; NaN when constant."""
    n, sa, saa, sab = mom["n"], mom["sa"], mom["saa"], mom["sab"]
    sb = sa.T          # Σ x_j over rows where x_i non-NULL
    sbb = saa.T
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = sab - sa * sb / n
        va = saa - sa * sa / n
        vb = sbb - sb * sb / n
        r = cov / np.sqrt(va * vb)
    r[(va <= 0) | (vb <= 0) | (n < 2)] = np.nan
    return r


def quantile_row(df: DataFrame, cols: list[str], probs: list[float], approx: bool = False) -> DataFrame:
    """One-row frame with q{i}_{j} = quantile probs[j] of cols[i] (NULL for an
    all-NULL column): exact from the distributed order, or with ``approx`` from
    one bounded-memory sketch per column (rank error 1 in 10 000), without a
    shuffle of the values."""
    if approx:
        d = df.select(*[F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(cols)])
        sketch = d.agg(*[F.percentile_approx(f"c{i}", probs, 10_000).alias(f"s{i}") for i in range(len(cols))])
        return sketch.select(*[F.col(f"s{i}")[j].alias(f"q{i}_{j}") for i in range(len(cols)) for j in range(len(probs))])
    g = grouped_quantiles(long_counts(df, cols), probs)
    aggs = [F.max(F.when(F.col("column_name") == c, F.col(f"q{j}"))).alias(f"q{i}_{j}")
            for i, c in enumerate(cols) for j in range(len(probs))]
    return g.agg(*aggs)


def group_quantiles(df: DataFrame, by: str, value: str, probs: list[float]) -> DataFrame:
    """(by, q0..) exact quantiles of ``value`` per group of ``by``."""
    counts = (df.select(F.col(f"`{by}`").alias("_g"), F.col(f"`{value}`").cast("double").alias("value"))
              .where(F.col("_g").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
              .groupBy("_g", "value").agg(F.count(F.lit(1)).alias("cnt")))
    return grouped_quantiles(counts, probs, "_g").withColumnRenamed("_g", by)
