"""Exact k-nearest-neighbour search by a partition into boxes.

Points are first collapsed to distinct vectors with a multiplicity, so a
value repeated by a third of all rows is one point; a point is known by its
vector itself, not by a hash of it.

1. A hash sample of the distinct points is halved again and again, across the
   widest feature, until there is about a cell for ``cell_size`` points (at most
   ``MAX_CELLS``). A point finds its cell by walking down these cuts; a cell is
   known by the least box around its points and by its weight (one row a cell on
   the driver).
2. A query has a first bound from these rows alone: the farthest corner of the
   least box above its cell that holds k points. It searches its own cell, which
   tightens the bound.
3. A cell can hold a closer point only if its box is within the bound. The query
   walks down the boxes and visits these cells, and no others: two rounds,
   whatever the data, and the answer is exact.

What a query costs depends on the size of a cell, not on the number of points (up
to ``MAX_CELLS`` cells of ``cell_size``); finding its cells is a walk of logarithmic
length. A cell is searched in blocks of at most ``BLOCK`` points and ``CHUNK`` queries
(hashed, so a dense cell is many tasks). Inside a block only points whose
distance from the cell's centre differs from the query's by no more than the bound are
compared, and at most k points (one more if a query may meet itself) leave it
for each query. The cost is near-linear for data of low intrinsic dimension;
for isotropic high-dimensional data the bounds exclude fewer cells, which is
the inherent cost of exact search there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.ranks import exact_quantiles, running_before
from tessera.session import materialize

#: Cells, of which the driver and each task hold a box.
MAX_CELLS = 1 << 16
#: Points of the sample for each cell; a table of so many points is its own sample.
SAMPLE, WHOLE = 8, 4096
BLOCK = 8192
CHUNK = 4096
#: Relative slack of the bounds, far above rounding: they only exclude.
_SLACK = 1e-9
_GRID = 1 << 18  # distances computed at a time


def distinct_points(df: DataFrame, vec_col: str, extra: list[str] | None = None) -> DataFrame:
    """(pid, vec, w, *extra): distinct vectors (per extra key) with counts."""
    extra = extra or []
    g = df.groupBy(F.col(vec_col).alias("vec"), *[F.col(e) for e in extra]).agg(F.count(F.lit(1)).alias("w"))
    pid = F.struct("vec", *extra) if extra else F.col("vec")
    return g.select(pid.alias("pid"), "vec", *extra, "w")


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of a and b, summed dimension by dimension."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        out += d * d
    return np.sqrt(out)


class Cells:
    """The cuts of a sample with the boxes and weights of what lies between them: what a task needs to place points and to bound queries.

    Nodes are in order of their making, parents first; ``cell`` numbers those that are not cut."""

    def __init__(self, sample: np.ndarray, wanted: int):
        dim, most = sample.shape[1], -(-len(sample) // wanted)
        nodes: list[tuple] = []  # feature, cut, first child, cell
        self.parent, centres = [-1], []
        todo, at = [np.arange(len(sample))], 0
        while at < len(todo):
            rows = todo[at]
            todo[at] = None
            cut = _cut(sample[rows]) if len(rows) > most else None
            if cut is None:
                nodes.append((0, 0.0, -1, len(centres)))
                centres.append(sample[rows].mean(axis=0))
            else:
                nodes.append((*cut, len(todo), -1))
                below = sample[rows, cut[0]] <= cut[1]
                todo += [rows[below], rows[~below]]
                self.parent += [at, at]
            at += 1
        self.feature, self.child, self.cell = (np.array([n[i] for n in nodes], np.int64) for i in (0, 2, 3))
        self.cut, self.centres = np.array([n[1] for n in nodes]), np.array(centres).reshape(-1, dim)
        self.node = np.flatnonzero(self.cell >= 0)  # of a cell
        self.count = np.zeros(len(centres), np.int64)
        self.low, self.high, self.weight = np.full((len(nodes), dim), np.inf), np.full((len(nodes), dim), -np.inf), np.zeros(len(nodes))

    def hold(self, rows, k: int) -> None:
        """Takes (cell, count, weight, lowest, highest) of every cell, and for its queries the least box above it with k points."""
        for cell, count, weight, low, high in rows:
            at = self.node[cell]
            self.count[cell], self.weight[at], self.low[at], self.high[at] = count, weight, low, high
        for at in range(len(self.parent) - 1, 0, -1):
            up = self.parent[at]
            self.weight[up] += self.weight[at]
            np.minimum(self.low[up], self.low[at], out=self.low[up])
            np.maximum(self.high[up], self.high[at], out=self.high[up])
        enough = np.full(len(self.parent), -1)
        for at, up in enumerate(self.parent):
            enough[at] = at if self.weight[at] >= k else enough[up] if up >= 0 else -1
        self.enough = enough[self.node]

    def place(self, vecs: np.ndarray) -> np.ndarray:
        """The cell of every vector."""
        node = np.zeros(len(vecs), np.int64)
        going = np.flatnonzero(self.child[node] >= 0)
        while len(going):
            at = node[going]
            at = self.child[at] + ~(vecs[going, self.feature[at]] <= self.cut[at])
            node[going] = at
            going = going[self.child[at] >= 0]
        return self.cell[node]

    def from_centre(self, vecs: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.sqrt(((vecs - self.centres[cell]) ** 2).sum(axis=1))

    def first_bound(self, vecs: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Within it lie the points that the cells were to hold."""
        box = self.enough[cell]
        far = np.maximum(np.abs(vecs - self.low[box]), np.abs(self.high[box] - vecs))
        return np.where(box >= 0, np.sqrt((far * far).sum(axis=1)), np.inf)

    def within_reach(self, vecs: np.ndarray, bound: np.ndarray):
        """(rows, cells) in parts of bounded size: cells that can hold a point no farther than ``bound``."""
        bound = bound * (1 + _SLACK) + _SLACK
        todo = [(np.arange(len(vecs)), np.zeros(len(vecs), np.int64))]
        while todo:
            row, at = todo.pop()
            if len(row) > _GRID:
                half = len(row) // 2
                todo += [(row[:half], at[:half]), (row[half:], at[half:])]
                continue
            away = np.maximum(np.maximum(self.low[at] - vecs[row], vecs[row] - self.high[at]), 0.0)
            near = np.sqrt((away * away).sum(axis=1)) <= bound[row]
            row, at = row[near], at[near]
            inner = self.child[at] >= 0
            if not inner.all():
                yield row[~inner], self.cell[at[~inner]]
            if inner.any():
                row, first = row[inner], self.child[at[inner]]
                todo.append((np.concatenate([row, row]), np.concatenate([first, first + 1])))


def _cut(points: np.ndarray) -> tuple[int, float] | None:
    """(feature, highest value of the lower half): across the widest feature of those that give no part under a quarter, if any."""
    n, best = len(points), None
    for f in range(points.shape[1]):
        v = np.sort(points[:, f])
        some = [int(i) for i in (np.searchsorted(v, v[n // 2], "left"), np.searchsorted(v, v[n // 2], "right")) if 0 < i < n]
        if not some:
            continue
        i = min(some, key=lambda i: abs(2 * i - n))
        least = min(i, n - i)
        rank = (1, v[n - 1 - n // 8] - v[n // 8]) if 4 * least >= n else (0, least)
        if best is None or rank > best[0]:
            best = rank, f, float(v[i - 1])
    return best and best[1:]


def _cells(refs: DataFrame, dim: int, n: int, cell_size: int) -> Cells:
    wanted = min(MAX_CELLS, -(-n // cell_size))
    vecs = refs.select("vec")
    if n > max(WHOLE, SAMPLE * wanted):
        vecs = vecs.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 40)) < int(SAMPLE * wanted / n * (1 << 40)))
    sample = _matrix(vecs.toArrow().column("vec"), dim)  # at most SAMPLE * MAX_CELLS rows, or WHOLE
    sample = np.unique(sample[np.isfinite(sample).all(axis=1)], axis=0)
    return Cells(sample if len(sample) else np.zeros((1, dim)), wanted)


def _placed(df: DataFrame, cells: Cells, bounded: bool = False) -> DataFrame:
    """``df`` plus its cell and the distance to that centre; ``bounded`` adds the first bound."""
    dim = cells.centres.shape[1]
    added = [("cell", T.IntegerType()), ("pd", T.DoubleType())] + ([("bound", T.DoubleType())] if bounded else [])
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def run(batches):
        for batch in batches:
            vecs = _matrix(batch.column(batch.schema.get_field_index("vec")), dim)
            cell = cells.place(vecs)
            extra = [pa.array(cell.astype(np.int32)), pa.array(cells.from_centre(vecs, cell))] + ([pa.array(cells.first_bound(vecs, cell))] if bounded else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return df.mapInArrow(run, schema)


def _visits(queries: DataFrame, cells: Cells) -> DataFrame:
    """A row for every query and every cell but its own that its bound reaches; ``pd`` is the distance to that cell's centre."""
    dim = cells.centres.shape[1]

    def run(batches):
        for batch in batches:
            vecs = _matrix(batch.column(batch.schema.get_field_index("vec")), dim)
            own, bound = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "bound"))
            for row, cell in cells.within_reach(vecs, bound):
                other = (cell != own[row]) & (cells.count[cell] > 0)
                row, cell = row[other], cell[other]
                for at in range(0, len(row), 1 << 16):
                    some, c = row[at: at + (1 << 16)], cell[at: at + (1 << 16)]
                    part = batch.take(pa.array(some))
                    new = {"cell": pa.array(c.astype(np.int32)), "pd": pa.array(cells.from_centre(vecs[some], c))}
                    yield pa.RecordBatch.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(part.schema.names)], names=part.schema.names)

    return queries.mapInArrow(run, queries.schema)


def block_best(q: np.ndarray, q_pd: np.ndarray, bound: np.ndarray, r: np.ndarray, r_pd: np.ndarray, w: np.ndarray, k: int):
    """(query rows, point rows, distances): for each query its nearest points of a block up to weight k, none beyond its bound.

    Points are in order of their ids, and so are points of equal distance.
    """
    by_pd = np.argsort(r_pd, kind="stable")
    ring, slack = r_pd[by_pd], _SLACK * (1 + q_pd)
    reach = bound * (1 + _SLACK) + slack
    low, high = np.searchsorted(ring, q_pd - reach - slack, "left"), np.searchsorted(ring, q_pd + reach + slack, "right")
    found: list[tuple] = []
    order = np.argsort(low, kind="stable")
    at = 0
    while at < len(order):
        some, top = [order[at]], high[order[at]]
        while at + len(some) < len(order) and (len(some) + 1) * (max(top, high[order[at + len(some)]]) - low[some[0]]) <= _GRID:
            top = max(top, high[order[at + len(some)]])
            some.append(order[at + len(some)])
        at += len(some)
        near = np.sort(by_pd[low[some[0]]: top])
        if not len(near):
            continue
        some = np.asarray(some)
        dist, limit = _distances(q[some], r[near]), reach[some]
        if len(near) > k:  # every point weighs one at least: the k-th distance and its ties are enough
            limit = np.minimum(np.partition(dist, k - 1, axis=1)[:, k - 1], limit)
        row, point = np.nonzero(dist <= limit[:, None])
        d = dist[row, point]
        by = np.lexsort((point, d, row))
        row, point, d = row[by], near[point[by]], d[by]
        before = np.cumsum(w[point]) - w[point]
        first = np.searchsorted(row, row, "left")  # of the same query
        keep = before - before[first] < k
        found.append((some[row[keep]], point[keep], d[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(queries: DataFrame, refs: DataFrame, cells: Cells, k: int, payload: list[str]) -> DataFrame:
    """(qid, pid, *payload, dist, w, cell, block): the block searches of queries placed in cells."""
    spark, dim = refs.sparkSession, cells.centres.shape[1]
    asked = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    rows = [(int(c), int(-(-cells.count[c] // BLOCK)), int(-(-n // CHUNK))) for c, n in asked.items() if cells.count[c]]
    layout = F.broadcast(spark.createDataFrame(rows, "cell int, blocks int, chunks int"))
    q = queries.join(layout, "cell").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
    q = q.select("qid", "vec", "pd", "bound", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    r = refs.join(layout, "cell").withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
    r = r.select(F.col("pid"), F.col("vec").alias("rvec"), F.col("pd").alias("rpd"), *payload, "w", F.col("cell").alias("rcell"),
                 F.col("block").alias("rblock"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("rchunk"))
    fields = [T.StructField("qid", queries.schema["qid"].dataType), T.StructField("pid", refs.schema["pid"].dataType), *(refs.schema[p] for p in payload),
              T.StructField("dist", T.DoubleType()), T.StructField("w", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType())]
    schema = T.StructType(fields)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = schema.names
        if not left.num_rows or not right.num_rows:
            i = j = np.zeros(0, np.int64)
            dist, weight = np.zeros(0), np.zeros(0, np.int64)
        else:
            vecs = _matrix(right.column("rvec"), dim)
            extra = [np.array(right.column(p).to_pylist(), dtype=object) for p in reversed(payload)]
            ranked = [np.unique(x.astype(str) if any(not isinstance(v, (int, float)) for v in x) else x.astype(float), return_inverse=True)[1] for x in extra]
            right = right.take(pa.array(np.lexsort([*ranked, *(vecs[:, d] for d in reversed(range(dim)))])))
            vecs, weights = _matrix(right.column("rvec"), dim), right.column("w").to_numpy()
            i, j, dist = block_best(_matrix(left.column("vec"), dim), left.column("pd").to_numpy(), left.column("bound").to_numpy(),
                                    vecs, right.column("rpd").to_numpy(), weights, k)
            weight = weights[j]
        columns = [left.column("qid").take(pa.array(i)), right.column("pid").take(pa.array(j)), *(right.column(p).take(pa.array(j)) for p in payload),
                   pa.array(dist), pa.array(weight, pa.int64()), pa.array(np.full(len(i), key[0].as_py(), np.int32)), pa.array(np.full(len(i), key[1].as_py(), np.int32))]
        return pa.table(columns, names=names)

    return q.groupBy("cell", "block", "chunk").cogroup(r.groupBy("rcell", "rblock", "rchunk")).applyInArrow(run, schema)


def _weights(found: DataFrame, exclude_self: bool) -> DataFrame:
    """``found`` without the copy of itself that a query does not count."""
    weight = F.col("w") - F.when(F.col("qid") == F.col("pid"), 1).otherwise(0) if exclude_self else F.col("w")
    return found.withColumn("w", weight).where("w > 0")


def _nearest(found: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """``found`` cut to the k nearest copies of every query; ``c`` of a point's copies are among them."""
    left = _weights(found, exclude_self)
    win = Window.partitionBy("qid").orderBy("dist", "pid").rowsBetween(Window.unboundedPreceding, -1)
    top = left.withColumn("_before", F.coalesce(F.sum("w").over(win), F.lit(0))).where(F.col("_before") < k)
    return top.withColumn("c", F.least(F.col("w"), F.lit(k) - F.col("_before"))).drop("_before", "w", "cell", "block")


def knn_search(queries: DataFrame, refs: DataFrame, k: int, dim: int, exclude_self: bool = False,
               cell_size: int = 1024, payload: list[str] | None = None) -> DataFrame:
    """Exact weighted kNN.

    queries: (qid, vec), a row per qid; refs: (pid, vec, w, *payload) with pid the
    vector, or a struct of it and the payload. Returns (qid, pid, *payload,
    dist, c) where ``c`` is the number of copies of reference point ``pid`` among
    the k nearest (sum of c per qid = k, or all reference weight when there is
    less); points of equal distance are taken in order of pid. With
    ``exclude_self`` a query whose qid equals a pid does not count one copy of
    itself (training-set neighbours, as in LOF). No references or no queries
    give an empty result.
    """
    payload = payload or []
    most = k + 1 if exclude_self else k
    refs, queries = materialize(refs, "knn-points"), materialize(queries.select("qid", "vec"), "knn-queries")
    n = refs.count()
    if not n:
        empty = T.StructType([queries.schema["qid"], refs.schema["pid"], *(refs.schema[p] for p in payload), T.StructField("dist", T.DoubleType()), T.StructField("c", T.LongType())])
        return refs.sparkSession.createDataFrame([], empty)
    cells = _cells(refs, dim, n, cell_size)
    refs = materialize(_placed(refs, cells).where(~F.isnan("pd")), "knn-cells")
    held = refs.groupBy("cell").agg(F.count(F.lit(1)), F.sum("w"), F.array(*[F.min(F.col("vec")[i]) for i in range(dim)]), F.array(*[F.max(F.col("vec")[i]) for i in range(dim)]))
    cells.hold(held.collect(), most)  # a row a cell
    queries = materialize(_placed(queries, cells, bounded=True), "knn-queries")
    near = materialize(_search(queries, refs, cells, most, payload), "knn-own")
    # a block that alone holds k copies bounds its query
    met = _weights(near, exclude_self).groupBy("qid", "block").agg(F.max("dist").alias("dk"), F.sum("w").alias("got")).where(F.col("got") >= k)
    got = met.groupBy(F.col("qid").alias("of")).agg(F.min("dk").alias("dk"))
    bounded = queries.join(got, F.col("qid") == F.col("of"), "left").select("qid", "vec", "cell", "pd", F.least("bound", "dk").alias("bound"))
    visits = materialize(_visits(bounded, cells), "knn-visits")
    beyond = _search(visits, refs, cells, most, payload)
    return materialize(_nearest(near.unionByName(beyond), k, exclude_self), "knn")


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Majority vote of the k nearest training rows (smallest label wins a
    tie). train/test: (label, features vector). Returns (label, prediction)
    per test row."""
    from pyspark.ml.functions import vector_to_array
    tr = train.select("label", vector_to_array("features").alias("vec"))
    te = test.select("label", vector_to_array("features").alias("vec"))
    one = tr.select("vec").first()
    if one is None:  # nothing to vote
        return te.select("label", F.lit(None).cast("double").alias("prediction")).limit(0)
    dim = len(one["vec"])
    refs = distinct_points(tr, "vec", ["label"])
    qs = te.select(F.col("vec").alias("qid"), "vec").distinct()
    nn = knn_search(qs, refs, k, dim, payload=["label"])
    votes = nn.groupBy("qid", "label").agg(F.sum("c").alias("v"))
    best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("v")).alias("nv"), F.col("label").alias("l"))).alias("b"))
    pred = best.select("qid", F.col("b.l").alias("prediction"))
    return te.withColumn("qid", F.col("vec")).join(pred, "qid").select("label", "prediction")


def lof_scores(df: DataFrame, cols: list[str], k: int = 20) -> DataFrame:
    """Local Outlier Factor per complete row: (original columns, lof).
    Duplicates are neighbours at distance 0; the mean reachability gets the
    usual 1e-10 floor."""
    d = df.dropna(subset=cols)
    vec = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    pts = distinct_points(d.select(vec.alias("vec")), "vec").select("vec", "w", F.lit(1).cast("long").alias("_one"))
    # neighbours are kept by the number of a point in the order of all: vectors in their place would be most of what is moved
    pts = materialize(running_before(pts, "vec", "_one").select(F.col("before").alias("pid"), "vec", "w"), "lof-points")
    nn = knn_search(pts.select(F.col("pid").alias("qid"), "vec"), pts, k, len(cols), exclude_self=True)
    kd = nn.groupBy("qid").agg(F.max("dist").alias("kdist"), F.sum("c").alias("kc"))
    reach = nn.join(kd.select(F.col("qid").alias("pid"), F.col("kdist").alias("okd")), "pid").select(
        "qid", "pid", "c", F.greatest(F.col("okd"), F.col("dist")).alias("reach"))
    lrd = reach.groupBy("qid").agg((1.0 / (F.sum(F.col("c") * F.col("reach")) / F.sum("c") + 1e-10)).alias("lrd"))
    lof = (nn.join(lrd.select(F.col("qid").alias("pid"), F.col("lrd").alias("olrd")), "pid")
           .groupBy("qid").agg((F.sum(F.col("c") * F.col("olrd")) / F.sum("c")).alias("_m"))
           .join(lrd, "qid").select(F.col("qid").alias("pid"), (F.col("_m") / F.col("lrd")).alias("lof")))
    return d.withColumn("vec", vec).join(lof.join(pts, "pid").select("vec", "lof"), "vec").drop("vec")


def lof_flags(df: DataFrame, cols: list[str], k: int = 20, contamination: float = 0.05) -> DataFrame:
    """Rows with LOF above the (1 − contamination) quantile are anomalies;
    incomplete rows are never flagged."""
    s = materialize(lof_scores(df, cols, k), "lof")  # read for the threshold and for the flags
    thr = exact_quantiles(s, "lof", [1.0 - contamination]).select(F.col("q0").alias("_thr"))
    flagged = s.crossJoin(F.broadcast(thr)).withColumn("is_anomaly", F.col("lof") > F.col("_thr")).drop("_thr")
    incomplete = df.where(" OR ".join(f"`{c}` IS NULL" for c in cols) if cols else "false")
    return flagged.drop("lof").unionByName(incomplete.withColumn("is_anomaly", F.lit(False)))

