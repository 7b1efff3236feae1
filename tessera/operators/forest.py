"""Regression trees on counted cells of binned features.

A tree on at most ``bins`` bins per feature sees of a row only its bins and its
label, and of rows with the same bins (a cell) only their number and the sum of
their labels. So rows are binned once and added up by cell; what the trees are
grown from is bounded by the bins, not by the rows.

* Cuts are exact quantiles of the training rows (every value, where there are no
  more values than bins), half-way between neighbouring values.
* A forest's bootstrap gives every row a Poisson(1) count per tree. Equal rows are
  counted first: so many copies together have a Poisson count of that rate. The
  draw is a hash of the row and the tree, whatever the partitions are. Rows are
  range-partitioned by (cell, label), so that tasks add up neighbouring rows and a
  full cell is several tasks'.
* A tree is grown from its cells, all nodes of a level together, a task a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.colstats import grouped_positions, long_counts
from tessera.session import materialize

#: Cells that a task holds at most (three features of 64 bins); beyond it there is no forest on cells.
MAX_CELLS = 1 << 18
#: Copies of a row that share a draw; the exponential of its negative is still a normal number.
COPIES = 512


def bin_cuts(rows: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """Per column at most ``bins`` - 1 cuts, ascending; the driver gets a row per column and bin."""
    pos = grouped_positions(long_counts(rows, cols))
    sizes = pos.groupBy("column_name").agg(F.sum("cnt").alias("_n"), F.count(F.lit(1)).alias("_values"))
    # the bin in which the middle of a value's rows lies
    place = F.ceil((F.col("before") + F.col("cnt") / 2) * bins / F.col("_n")).cast("double")
    key = F.when(F.col("_values") <= bins, F.col("value")).otherwise(place)
    ends = pos.join(F.broadcast(sizes), "column_name").groupBy("column_name", key.alias("_bin")).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    cuts = []
    for c in cols:
        own = sorted((r["lo"], r["hi"]) for r in ends if r["column_name"] == c)
        cuts.append([a[1] + (b[0] - a[1]) / 2 for a, b in zip(own, own[1:])])
    return cuts


def _codes(batch: pa.RecordBatch, cols: list[str], cuts: list[list[float]]) -> list[np.ndarray]:
    """Per column how many cuts lie below the value."""
    return [np.searchsorted(np.asarray(cut, float), batch.column(c).to_numpy(zero_copy_only=False)) for c, cut in zip(cols, cuts)]


def binned(rows: DataFrame, cols: list[str], cuts: list[list[float]]) -> DataFrame:
    """(b0, b1, ..., label): the bins of every row."""
    names = [f"b{i}" for i in range(len(cols))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [pa.array(c.astype(np.int32)) for c in _codes(batch, cols, cuts)]
            yield pa.RecordBatch.from_arrays([*codes, batch.column("label")], names=[*names, "label"])

    return rows.select(*cols, "label").mapInArrow(run, ", ".join(f"{n} int" for n in names) + ", label double")


def in_cells(rows: DataFrame, cols: list[str], cuts: list[list[float]]) -> DataFrame:
    """(cell, label): the bins of every row as one number, the last feature's the units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for code, cut in zip(_codes(batch, cols, cuts), cuts):
                cell = cell * (len(cut) + 1) + code
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("label")], names=["cell", "label"])

    return rows.select(*cols, "label").mapInArrow(run, "cell int, label double")


@lru_cache(maxsize=None)
def _poisson_steps(rate: int) -> np.ndarray:
    """A 32-bit number reaches so many of these steps as the Poisson count of the rate it stands for."""
    term, below, steps = math.exp(-rate), 0.0, []
    while len(steps) < rate or term > 2.0 ** -34:
        below += term
        steps.append(below)
        term *= rate / len(steps)
    return np.minimum(np.asarray(steps) * 2.0 ** 32, 2.0 ** 32).astype(np.uint64)


def bag_counts(key: np.ndarray, copies: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees): how often each tree draws a row that stands for so many copies (SplitMix64 of key and tree)."""
    z = key.astype(np.uint64)[:, None] + np.arange(1, trees // 2 + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    u = np.ascontiguousarray(z).view(np.uint32)[:, :trees]
    out = np.zeros(u.shape)
    for rate in np.unique(copies):
        rows = np.flatnonzero(copies == rate)
        steps = _poisson_steps(int(rate))
        if rate == 1:
            some = u if len(rows) == len(u) else u[rows]
            count = np.zeros(some.shape, np.uint8)
            for s in steps[steps < 2 ** 32].astype(np.uint32):
                count += some >= s
            out[rows] = count
        else:
            out[rows] = np.searchsorted(steps, u[rows].astype(np.uint64), side="right")
    return out


def bags(cells: DataFrame, trees: int, seed: int, centre: float) -> DataFrame:
    """(tree, cell, n, s): rows that a tree's bootstrap draws of a cell, and the sum of their labels less ``centre``.

    A cell is in several rows of a tree where its rows were in several batches."""
    counts = cells.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("_cnt"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_cnt") - 1) / COPIES).cast("long")))
    dealt = counts.select("cell", "label", "_cnt", runs.alias("_run"))
    rows = dealt.select("cell", (F.col("label") - centre).alias("y"), "_run",
                        F.least(F.lit(COPIES), F.col("_cnt") - F.col("_run") * COPIES).cast("int").alias("copies"),
                        F.xxhash64(F.lit(seed), "cell", "label", "_run").alias("key"))
    rows = rows.repartitionByRange("cell", "y", "_run").sortWithinPartitions("cell", "y", "_run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, y, copies, key = (batch.column(c).to_numpy() for c in ("cell", "y", "copies", "key"))
            start = np.flatnonzero(np.diff(cell, prepend=-1))
            drawn = bag_counts(key, copies, trees)
            n, s = np.add.reduceat(drawn, start, axis=0), np.add.reduceat(drawn * y[:, None], start, axis=0)
            at, tree = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(cell[start][at]), pa.array(n[at, tree]), pa.array(s[at, tree])],
                                             names=["tree", "cell", "n", "s"])

    return rows.select("cell", "y", "copies", "key").mapInArrow(run, "tree int, cell int, n double, s double")


def grow(n: np.ndarray, s: np.ndarray, bins: list[int], max_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean of the leaf of every cell, gain per feature) of one tree by least squares.

    A node is split where the squared error falls most (the first of equal splits, features in order), as long as it falls."""
    size = len(n)
    codes = np.unravel_index(np.arange(size), bins)
    node, value, gains = np.zeros(size, np.int64), np.zeros(size), np.zeros(len(bins))
    live, k = np.arange(size), 1  # cells of open nodes, and how many nodes are open
    for depth in range(max_depth + 1):
        total_n, total_s = np.bincount(node[live], n[live], k), np.bincount(node[live], s[live], k)
        mean = total_s / total_n
        value[live] = mean[node[live]]
        if depth == max_depth:
            break
        best, feature, cut = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
        for f, b in enumerate(bins):
            if b < 2:
                continue
            slot = node[live] * b + codes[f][live]
            left_n = np.bincount(slot, n[live], k * b).reshape(k, b).cumsum(axis=1)[:, :-1]
            left_s = np.bincount(slot, s[live], k * b).reshape(k, b).cumsum(axis=1)[:, :-1]
            right_n, right_s = total_n[:, None] - left_n, total_s[:, None] - left_s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left_s ** 2 / left_n + right_s ** 2 / right_n - (total_s * mean)[:, None]
            gain = np.where((left_n > 0) & (right_n > 0), gain, 0.0)
            slack = 1e-9 * gain.max(axis=1) + 1e-12 * np.abs(total_s * mean)  # sums in another order are no better split
            at = (gain >= (gain.max(axis=1) - slack)[:, None]).argmax(axis=1)
            top = gain[np.arange(k), at]
            better = top > best + slack
            best[better], feature[better], cut[better] = top[better], f, at[better]
        split = feature >= 0
        if not split.any():
            break
        np.add.at(gains, feature[split], best[split])
        live = live[split[node[live]]]
        order, of = np.cumsum(split) - 1, node[live]
        code = np.stack(codes)[feature[of], live]
        node[live] = 2 * order[of] + (code > cut[of])
        k = 2 * int(split.sum())
    return value, gains


@dataclass
class Forest:
    """``cells`` (cell, prediction) covers every cell; ``importances`` add up to 1 (0 without a split)."""

    cols: list[str]
    cuts: list[list[float]]
    cells: DataFrame
    importances: list[float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """(label, prediction) of every row."""
        # at most MAX_CELLS rows
        return in_cells(rows, self.cols, self.cuts).join(F.broadcast(self.cells), "cell").select("label", "prediction")


def fit_forest(train: DataFrame, cols: list[str], trees: int, max_depth: int, max_bins: int, seed: int, centre: float) -> Forest | None:
    """Mean of ``trees`` trees, each on a bootstrap of (``cols``, label); None if the bins give more than ``MAX_CELLS`` cells.

    ``centre`` is the mean label: sums are taken about it."""
    cuts = bin_cuts(train, cols, max_bins)
    bins = [len(c) + 1 for c in cuts]
    size = math.prod(bins)
    if size > MAX_CELLS:
        return None
    drawn = bags(in_cells(train, cols, cuts), trees, seed, centre)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "n", "s"])  # equal sums whatever the order of arrival
        n, s = (np.bincount(pdf["cell"], pdf[c], size) for c in ("n", "s"))
        value, gains = grow(n, s, bins, max_depth)
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "value": [value], "gains": [gains]})

    grown = materialize(drawn.groupBy("tree").applyInPandas(tree, "tree int, value array<double>, gains array<double>"), "forest")
    share = np.zeros(len(cols))
    for r in grown.select("gains").orderBy("tree").collect():  # a row a tree
        share += np.asarray(r["gains"]) / (sum(r["gains"]) or 1.0)
    cells = grown.select(F.posexplode("value").alias("cell", "p")).groupBy("cell").agg((F.avg("p") + centre).alias("prediction"))
    return Forest(cols, cuts, materialize(cells, "forest-cells"), (share / (share.sum() or 1.0)).tolist())
