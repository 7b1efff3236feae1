"""Gradient boosting for any number of classes: K trees a round on softmax residuals.

Spark ML's booster knows two classes. Here every round grows one regression tree
per class on the residuals (1 if the row is of the class, else 0, less its
softmax probability), and all classes share one row of scores.

* Features are cut into at most ``bins`` quantile bins once; rows that agree in
  label and bins become one row with a weight, so copies cost nothing.
* A level of all K trees is one job: tasks sum weight, residual and curvature per
  (class, node, feature, bin) with numpy, Spark adds the sums up, and the driver
  gets at most classes x nodes x features x bins rows, whatever the input.
* Scores are written to the shared folder every few rounds; in between, tasks
  add the trees that are newer than the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

#: One tree per class and round: more classes than this are taken for a mistake.
MAX_CLASSES = 256


@dataclass
class Booster:
    """``feature`` and ``cut`` (per round: class x inner node, in heap order) and ``leaf`` (class x leaf)."""

    classes: np.ndarray
    edges: list[list[float]]
    prior: np.ndarray
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    #: Mean log-loss of the training rows before each round.
    losses: list[float] = field(default_factory=list)
    gain: np.ndarray | None = None


def _descend(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row after so many levels of one tree, from 0 at the left."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for level in range(levels):
        at = (1 << level) - 1 + node
        node = 2 * node + (codes[rows, feature[at]] > cut[at])
    return node


def _added(codes: np.ndarray, b: Booster, first: int) -> np.ndarray:
    """What the rounds from ``first`` on add to the scores."""
    out = np.zeros((len(codes), len(b.classes)))
    for feature, cut, leaf in zip(b.feature[first:], b.cut[first:], b.leaf[first:]):
        for k in range(len(b.classes)):
            out[:, k] += leaf[k][_descend(codes, feature[k], cut[k], b.depth)]
    return out


def _log_softmax(score: np.ndarray) -> np.ndarray:
    low = score - score.max(axis=1, keepdims=True)
    return low - np.log(np.exp(low).sum(axis=1, keepdims=True))


def _coded(rows: DataFrame, edges: list[list[float]]) -> list:
    """Bin columns b0, b1, ...: how many edges lie below the value."""
    x = vector_to_array("features")
    cuts = [F.array(*[F.lit(float(e)) for e in es]).cast("array<double>") for es in edges]

    def below(c, value):
        return F.size(F.filter(c, lambda e: e < value))

    return [below(c, x[i]).alias(f"b{i}") for i, c in enumerate(cuts)]


def _arrays(pdf: pd.DataFrame, d: int) -> np.ndarray:
    return pdf[[f"b{i}" for i in range(d)]].to_numpy(np.int64)


def _sums(table: DataFrame, b: Booster, first: int, feature: np.ndarray, cut: np.ndarray, level: int, bins: int) -> tuple[np.ndarray, float]:
    """Weight, residual and curvature per (class, node, feature, bin) of one level, and the log-loss (summed)."""
    k_n, d, nodes = len(b.classes), len(b.edges), 1 << level
    size = nodes * d * bins

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, loss = np.zeros((3, k_n, size)), 0.0
        for pdf in batches:
            codes, w = _arrays(pdf, d), pdf["w"].to_numpy(float)
            y = np.searchsorted(b.classes, pdf["label"].to_numpy(float))
            logp = _log_softmax(pdf[[f"s{k}" for k in range(k_n)]].to_numpy(float) + _added(codes, b, first))
            loss -= float((w * logp[np.arange(len(y)), y]).sum())
            r = -np.exp(logp)
            r[np.arange(len(y)), y] += 1.0
            h = np.abs(r) * (1.0 - np.abs(r))
            for k in range(k_n):
                node = _descend(codes, feature[k], cut[k], level)
                for f in range(d):
                    slot = (node * d + f) * bins + codes[:, f]
                    for i, v in enumerate((w, w * r[:, k], w * h[:, k])):
                        acc[i, k] += np.bincount(slot, v, size)
        flat = acc.reshape(3, -1)
        live = np.flatnonzero(flat[0])
        yield pd.DataFrame({"slot": np.append(live, -1), "w": np.append(flat[0, live], loss), "r": np.append(flat[1, live], 0.0), "h": np.append(flat[2, live], 0.0)})

    total = table.mapInPandas(part, "slot long, w double, r double, h double").groupBy("slot").agg(F.sum("w").alias("w"), F.sum("r").alias("r"), F.sum("h").alias("h")).toPandas()
    loss = float(total.loc[total["slot"] < 0, "w"].sum())
    total = total[total["slot"] >= 0]
    out = np.zeros((3, k_n * size))
    out[:, total["slot"].to_numpy()] = total[["w", "r", "h"]].to_numpy().T
    return out.reshape(3, k_n, nodes, d, bins), loss


def _split(s: np.ndarray) -> tuple[int, int, float, np.ndarray]:
    """Best split of one node's sums (3 x features x bins): feature, last bin of the left side, gain, and the two
    sides' (residual, curvature). Gains that differ by rounding alone are equal: the first feature and bin win."""
    d, bins = s.shape[1:]
    left = np.cumsum(s, axis=2)
    whole = left[:, :, -1:]
    lw, rw = left[0], whole[0] - left[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((lw > 0) & (rw > 0), lw * rw / (lw + rw) * (left[1] / lw - (whole[1] - left[1]) / rw) ** 2, 0.0)
    best = gain.max()
    if best <= 1e-12:
        return 0, bins, 0.0, np.stack([whole[1:, 0, 0], np.zeros(2)])
    f, c = divmod(int(np.argmax(gain.ravel() >= best * (1 - 1e-9))), bins)
    return f, c, float(best), np.stack([left[1:, f, c], whole[1:, f, 0] - left[1:, f, c]])


def fit(rows: DataFrame, rounds: int = 100, depth: int = 3, rate: float = 0.1, bins: int = 32, keep: int = 10) -> Booster:
    """Train on (label double, features vector); scores begin at the logarithm of the classes' shares.

    ``keep``: rounds between two writings of the scores. A node whose rows agree in every bin stays whole.
    ValueError for no rows or more than ``MAX_CLASSES`` classes."""
    shares = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(MAX_CLASSES + 1).collect()
    if not 0 < len(shares) <= MAX_CLASSES:
        raise ValueError(f"boosting needs 1 to {MAX_CLASSES} classes")
    n, k_n = sum(r["n"] for r in shares), len(shares)
    x = vector_to_array("features")
    d = rows.select(F.size(x).alias("d")).first()["d"]
    at = [i / bins for i in range(1, bins)]
    q = rows.agg(*[F.percentile_approx(x[i], at, 10_000).alias(f"q{i}") for i in range(d)]).first()
    b = Booster(np.array([r["label"] for r in shares]), [sorted(set(q[f"q{i}"])) for i in range(d)], np.log([r["n"] / n for r in shares]), depth)
    b.gain = np.zeros(d)
    names = [f"b{i}" for i in range(d)]
    coded = rows.select("label", *_coded(rows, b.edges)).groupBy("label", *names).agg(F.count(F.lit(1)).alias("w"))
    table = materialize(coded.select("label", "w", *names, *[F.lit(float(s)).alias(f"s{k}") for k, s in enumerate(b.prior)]), "boost")
    first = 0
    for done in range(1, rounds + 1):
        feature, cut = np.zeros((k_n, (1 << depth) - 1), np.int64), np.full((k_n, (1 << depth) - 1), bins, np.int64)
        leaf = np.zeros((k_n, 1 << depth))
        for level in range(depth):
            sums, loss = _sums(table, b, first, feature, cut, level, bins)
            if level == 0:
                b.losses.append(loss / n)
            for k in range(k_n):
                for node in range(1 << level):
                    f, c, gain, sides = _split(sums[:, k, node])
                    i = (1 << level) - 1 + node
                    feature[k, i], cut[k, i] = f, c
                    b.gain[f] += gain
                    if level == depth - 1:
                        steep = sides[:, 1] > 1e-150
                        leaf[k, 2 * node:2 * node + 2] = np.where(steep, rate * (k_n - 1) / k_n * sides[:, 0] / np.where(steep, sides[:, 1], 1.0), 0.0)
        b.feature.append(feature), b.cut.append(cut), b.leaf.append(leaf)
        if done % keep == 0 and done < rounds:
            table, first = materialize(_advance(table, b, first), "boost"), done
    return b


def _advance(table: DataFrame, b: Booster, first: int) -> DataFrame:
    """The table with the scores after the rounds from ``first`` on."""
    d, scores = len(b.edges), [f"s{k}" for k in range(len(b.classes))]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[scores] = pdf[scores].to_numpy(float) + _added(_arrays(pdf, d), b, first)
            yield pdf

    return table.mapInPandas(add, table.schema)


def predict(b: Booster, rows: DataFrame) -> DataFrame:
    """label, prediction (of equal scores the smaller class) and probability (per class, ascending) of every row."""
    d = len(b.edges)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logp = _log_softmax(b.prior + _added(_arrays(pdf, d), b, 0))
            yield pd.DataFrame({"label": pdf["label"], "prediction": b.classes[logp.argmax(axis=1)], "probability": list(np.exp(logp))})

    return rows.select("label", *_coded(rows, b.edges)).mapInPandas(score, "label double, prediction double, probability array<double>")


def importance(b: Booster) -> list[float]:
    """Share of each feature in the gains of all splits."""
    return [float(g) for g in b.gain / (b.gain.sum() or 1.0)]
