"""Anomaly detection dispatcher and Isolation Forest.

Isolation Forest (Liu, Ting & Zhou 2008), library defaults: 100 trees, each
grown on 256 rows sampled without replacement, random feature and random
split between the node's min and max, depth limit ceil(log2 256) = 8.

* Sampling: rows collapse to (row, count); each copy joins tree t when a seeded
  hash of (t, row, number of the copy) falls under a rate giving ~4x256
  candidates per tree, so copies join independently of each other; the 256
  smallest hashes per tree are kept (salted top-k). Nothing is gathered beyond 100 x 256 rows.
* Building: ``groupBy(tree).applyInPandas`` grows the trees in parallel.
* Scoring: the forest is at most 100 x 511 nodes by construction — a proven
  size bound — so it is collected once and shipped to a ``mapInPandas``
  scorer over all complete rows.
* Threshold: rows scoring above the exact (1 − contamination) quantile of
  all scores are anomalies (distributed exact quantile).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.longform import occurrences, top_k_per_group
from tessera.functions.ranks import exact_quantiles
from tessera.operators import eda
from tessera.operators.knn import lof_flags
from tessera.session import materialize

N_TREES = 100
MAX_SAMPLES = 256
SEED = 42
NODE_SCHEMA = ("tree long, node long, feature int, threshold double, left long, right long, "
               "size long, depth int, leaf boolean")


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx), depth, True])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[me][1], nodes[me][2], nodes[me][7] = f, t, False
        nodes[me][3] = build(left, depth + 1)
        nodes[me][4] = build(right, depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


def sample_bound(rate: float) -> int:
    """Largest 63-bit hash that still joins a tree; never negative, so that no
    row count makes the sample empty by rounding."""
    return min((1 << 63) - 1, max(0, int(rate * (1 << 63)) - 1))


def build_forest(df: DataFrame, cols: list[str], n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
                 seed: int = SEED) -> DataFrame:
    """The forest as node rows (tree, node, feature, threshold, left, right,
    size, depth, leaf)."""
    xs = [f"x{i}" for i in range(len(cols))]
    # grouping takes 0.0 and -0.0 as one value
    d = df.dropna(subset=cols).select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(cols, xs)]).groupBy(*xs).agg(
        F.count(F.lit(1)).alias("_cnt"))
    n = d.agg(F.coalesce(F.sum("_cnt"), F.lit(0))).first()[0]
    psi = min(max_samples, n)
    rate = min(1.0, 4.0 * psi / max(n, 1))
    d = occurrences(d, xs, "_cnt")
    # per (tree, copy) a 63-bit hash; keep candidates under the rate, a bound of the same 63 bits
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    th = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col("_occ"), *[F.col(x) for x in xs]), 1)
    cand = d.select("*", F.explode(F.filter(trees, lambda t: th(t) <= sample_bound(rate))).alias("tree"))
    cand = cand.withColumn("_h", th(F.col("tree")))
    sample = top_k_per_group(cand, ["tree"], [F.col("_h"), *[F.col(x) for x in xs], F.col("_occ")], psi,
                             salt_on=F.col("_h")).drop("_h", "_occ", "rank")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    k = len(cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf[[f"x{i}" for i in range(k)]].to_numpy(dtype="float64")
        x = x[np.lexsort(x.T[::-1])]  # order-independent input
        rng = np.random.default_rng([seed, t])
        nodes = _grow(x, rng, max_depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth", "leaf"])
        out.insert(0, "tree", t)
        return out

    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def isolation_scores(df: DataFrame, cols: list[str], n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
                     seed: int = SEED) -> DataFrame:
    """Complete rows of ``df`` plus ``score`` = 2^(−E[h(x)] / c(ψ))."""
    forest = build_forest(df, cols, n_trees, max_samples, seed)
    nodes = forest.orderBy("tree", "node").toPandas()  # <= n_trees x (2^(depth+1) - 1) rows
    if len(nodes) and nodes["tree"].nunique() < n_trees:
        raise RuntimeError(f"only {nodes['tree'].nunique()} of {n_trees} trees drew a sample")
    psi = float(nodes.loc[nodes["node"] == 0, "size"].max()) if len(nodes) else 1.0
    # a node's path length, were it a leaf: depth plus what its points would add
    nodes["path"] = [d + _c(s) for d, s in zip(nodes["depth"], nodes["size"])]
    by_tree = {t: g.sort_values("node").astype("float64").to_numpy() for t, g in nodes.groupby("tree")}
    cnorm = _c(psi)
    d = df.dropna(subset=cols)
    schema = T.StructType(list(d.schema.fields) + [T.StructField("score", T.DoubleType())])

    def score(it):
        for pdf in it:
            x = pdf[list(cols)].to_numpy(dtype="float64")
            total = np.zeros(len(pdf))
            for arr in by_tree.values():
                node = np.zeros(len(pdf), dtype=np.int64)
                depth = np.zeros(len(pdf))
                active = np.ones(len(pdf), dtype=bool)
                while active.any():
                    leaf = arr[node, 8].astype(bool)
                    stop = active & leaf
                    if stop.any():
                        depth[stop] = arr[node[stop], 9]
                        active &= ~stop
                    go = np.flatnonzero(active)
                    if len(go) == 0:
                        break
                    f = arr[node[go], 2].astype(int)
                    thr = arr[node[go], 3]
                    xv = x[go, f]
                    node[go] = np.where(xv < thr, arr[node[go], 4], arr[node[go], 5]).astype(np.int64)
                total += depth
            mean_h = total / max(len(by_tree), 1)
            pdf = pdf.copy()
            pdf["score"] = np.power(2.0, -mean_h / cnorm) if cnorm > 0 else 0.5
            yield pdf

    return d.mapInPandas(score, schema)


def isolation_flags(df: DataFrame, cols: list[str], contamination: float = 0.05) -> DataFrame:
    s = materialize(isolation_scores(df, cols), "isolation")  # read for the threshold and for the flags
    thr = exact_quantiles(s, "score", [1.0 - contamination]).select(F.col("q0").alias("_thr"))
    flagged = s.crossJoin(F.broadcast(thr)).withColumn("is_anomaly", F.col("score") > F.col("_thr")) \
        .drop("_thr", "score")
    incomplete = df.where(" OR ".join(f"`{c}` IS NULL" for c in cols))
    return flagged.unionByName(incomplete.withColumn("is_anomaly", F.lit(False)))


METHOD_NAMES = {"iqr": "IQR", "zscore": "Z-Score", "isolation_forest": "Isolation Forest",
                "lof": "Local Outlier Factor"}


def detect(df: DataFrame, features: list[str], method: str = "iqr", contamination: float = 0.05):
    """Dispatch by method (unknown -> IQR). Returns (summary frame with
    method / count / % of all rows, flagged frame)."""
    if method == "zscore":
        f = eda.zscore_flags(df, features)
    elif method == "isolation_forest":
        f = isolation_flags(df, features, contamination)
    elif method == "lof":
        f = lof_flags(df, features, contamination=contamination)
    else:
        method = "iqr"
        f = eda.iqr_flags(df, features)
    return eda.anomaly_summary(f, METHOD_NAMES[method]), f
