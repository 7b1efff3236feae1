"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

1. Fit, on a bounded sample (``SAMPLE`` vectors in order of a hash): centroids of
   at most ``LISTS`` lists and a random rotation, both small and fixed in size.
2. Every vector goes to the list of its nearest centroid; lists are cut into
   blocks of at most ``BLOCK`` vectors, each one row with the vectors' bytes, so
   a list that holds a third of all rows is many blocks.
3. Every query visits its nearest lists (``PROBES`` of them all). A query starts
   with the distance of its k-th nearest in the sample as its threshold, and the
   k-th nearest found in a block tightens it for the rest of the block.
4. In a block the rotated vectors are scanned in column blocks. After d of D
   dimensions a candidate is abandoned if its partial squared distance exceeds
   threshold x d / D x (1 + EPSILON / sqrt(d))^2: after a random rotation this
   rejects the hypothesis that the full distance is within the threshold. What is
   left gets its exact cosine, in double precision, on the original vectors.

Squared distances are those of unit vectors, which order like the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices
from tessera.session import materialize

SAMPLE, SEEDS, LISTS, ROUNDS = 8_192, 1_024, 256, 8
BLOCK, CHUNK = 4_096, 256
#: Share of the lists that a query visits: evenly spread vectors need over half for nine neighbours of ten.
PROBES = 0.65
#: Columns of one step of the scan, and the strictness of the test.
COLUMNS, EPSILON = 16, 2.1
#: Room for rounding of single-precision distances: equal vectors must not be told apart.
SLACK = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no finite row overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that of y; a row's value depends on that row alone."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore", divide="ignore"):
        out = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    if len(odd := np.flatnonzero(~np.isfinite(out))):  # squares out of range
        a, b = (z[odd] / np.abs(z[odd]).max(axis=1, keepdims=True) for z in (x, y))
        out[odd] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return out


@dataclass
class Index:
    """What is fitted: unit centroids, the rotation, and the sample's first vectors as seeds of the thresholds."""

    centroids: np.ndarray
    rotation: np.ndarray
    seed_ids: np.ndarray
    seeds: np.ndarray

    @classmethod
    def fit(cls, ids: np.ndarray, sample: np.ndarray, lists: int = LISTS, seed: int = 42) -> Index:
        x, rng = unit(sample).astype(np.float32), np.random.default_rng(seed)
        k = max(1, min(lists, int(np.sqrt(len(x)) * 3), len(np.unique(x, axis=0))))
        centroids = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            nearest = (x @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(length > 0, sums / np.maximum(length, 1e-12), centroids)  # an empty list keeps its centroid
        rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
        return cls(centroids, rotation.astype(np.float32), ids[:SEEDS], sample[:SEEDS])

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return (unit(x).astype(np.float32) @ self.centroids.T).argmax(axis=1).astype(np.int32)

    def probes_of(self, x: np.ndarray, share: float) -> np.ndarray:
        n = max(1, int(np.ceil(share * len(self.centroids))))
        return np.argsort(-(unit(x).astype(np.float32) @ self.centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32)

    def seeded(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest seeds of each query (row, id, score) and its threshold, infinite with fewer than k."""
        scores = unit(x) @ unit(self.seeds).T
        scores[ids[:, None] == self.seed_ids[None, :]] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        row, place = np.nonzero(np.isfinite(np.take_along_axis(scores, order, 1)))
        at = order[row, place]
        full = np.bincount(row, minlength=len(x)) >= k
        limit = np.full(len(x), np.inf)
        if k <= order.shape[1]:
            limit[full] = 2 - 2 * np.take_along_axis(scores, order, 1)[full, k - 1]
        return row, self.seed_ids[at], cosines(x[row], self.seeds[at]), limit


def scan(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, rotation: np.ndarray,
         k: int, epsilon: float = EPSILON, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best (query row, id, score) of a block for each query, and the number of column values read."""
    x, q = unit(block).astype(np.float32) @ rotation, unit(queries).astype(np.float32) @ rotation
    dims, read = x.shape[1], 0
    tiles = [np.ascontiguousarray(x[:, a: a + columns]) for a in range(0, dims, columns)]  # one column block after another
    row, at = (z.ravel() for z in np.indices((len(q), len(x))))
    other = query_ids[row] != ids[at]
    row, at, partial = row[other], at[other], np.zeros(int(other.sum()), np.float32)
    done = 0
    for tile in tiles:
        gap = tile[at] - q[row, done: done + tile.shape[1]]
        partial += np.einsum("ij,ij->i", gap, gap)
        done += tile.shape[1]
        read += gap.size
        bound = limits[row] * (done / dims) * ((1 + epsilon / np.sqrt(done)) ** 2 if done < dims else 1) + SLACK
        stay = partial <= bound
        row, at, partial = row[stay], at[stay], partial[stay]
    score = cosines(block[at], queries[row])
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[at[place < k]], score[place < k], read


def tightened(best: np.ndarray, limits: np.ndarray, row: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each query (ascending) and the thresholds after a slice whose hits are grouped by query row."""
    new = np.full_like(best, -np.inf)
    new[row, np.arange(len(row)) - np.searchsorted(row, row)] = score
    best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, best.shape[1]:]
    return best, np.minimum(limits, 2 - 2 * best[:, 0])


def _matrix(part: pa.Array, dims: int) -> np.ndarray:
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part: not null, not zero, without null or non-finite components."""
    v = col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(F.coalesce("vec", F.array().cast("array<double>")), lambda x: x != 0))


def once(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
               probes: float = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id ``every`` divides its k nearest by cosine.

    All other vectors are candidates; ties go to the smaller id, and fewer than
    k candidates give as many rows. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those whose length is not the most
    frequent one, or rows without an id. Rows that repeat an id count once, with
    the least of their vectors that take part. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    taking = valid(vectors, id_col, vector_col)
    lengths = taking.select("vec_id", F.size("vec").alias("n")).distinct().groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths.n
    taking = taking.where(F.size("vec") == dims)
    # one row per id before anything is cut to k or to the sample: of rows that repeat it, that with the least vector
    picked = taking.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = once(taking.join(F.broadcast(picked), "vec_id", "left_semi")).orderBy(F.xxhash64("vec_id"), "vec_id").toArrow()
    index = Index.fit(sample["vec_id"].to_numpy(), _matrix(sample["vec"].combine_chunks(), dims))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("list", pa.int32()), *batch_schema])
        for part in slices(batches, BLOCK):
            yield emit(out, pa.array(index.lists_of(_matrix(part.column(1), dims))), *part.columns)

    batch_schema = [("vec_id", pa.int64()), ("vec", pa.list_(pa.float64()))]
    assigned = materialize(once(taking).mapInArrow(assign, "list int, vec_id long, vec array<double>"), "assigned")
    sizes = {r["list"]: r["count"] for r in assigned.groupBy("list").count().collect()}  # a row per list

    # candidates: blocks of bytes; a large list is dealt to several tasks
    parts = F.element_at(F.array(*(F.lit(max(1, -(-sizes.get(i, 0) // BLOCK))) for i in range(len(index.centroids)))), F.col("list") + 1)
    dealt = assigned.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    dealt = dealt.repartition("list", "part").sortWithinPartitions("list", "part")
    blocks = dealt.select("list", "vec_id", "vec").mapInArrow(_packer(BLOCK, dims), "list int, ids binary, block binary")

    # queries: one row for each visited list, packed likewise; the threshold follows the vector
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("list", pa.int32()), *batch_schema])
        for part in slices(batches, 256):
            ids, x = part.column(0).to_numpy(), _matrix(part.column(1), dims)
            lists, (_, _, _, limits) = index.probes_of(x, probes), index.seeded(ids, x, k)
            again = np.repeat(np.arange(len(ids)), lists.shape[1])
            flat = np.column_stack([x, limits])[again].ravel()
            asked = pa.ListArray.from_arrays(pa.array(np.arange(len(again) + 1) * (dims + 1), pa.int32()), pa.array(flat))
            yield emit(out, pa.array(lists.ravel()), pa.array(ids[again]), asked)

    asking = assigned.where(F.col("vec_id") % every == 0).select("vec_id", "vec")
    visits = asking.mapInArrow(visit, "list int, vec_id long, vec array<double>").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(8)))
    visits = visits.repartition("list", "part").sortWithinPartitions("list", "part").select("list", "vec_id", "vec")
    chunks = visits.mapInArrow(_packer(CHUNK, dims + 1), "list int, query_ids binary, queries binary")

    hit = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            ids, block, query_ids, queries = (np.frombuffer(part.column(i)[0].as_buffer(), t) for i, t in enumerate(("<i8", "<f8", "<i8", "<f8")))
            block, queries = block.reshape(-1, dims), queries.reshape(-1, dims + 1)
            queries, limits = np.ascontiguousarray(queries[:, :dims]), queries[:, dims]
            best = np.full((len(queries), k), -np.inf)
            for at in range(0, len(ids), 1024):
                row, found, score, _ = scan(ids[at: at + 1024], block[at: at + 1024], query_ids, queries, limits, index.rotation, k)
                best, limits = tightened(best, limits, row, score)
                yield emit(hit, pa.array(query_ids[row]), pa.array(found), pa.array(score))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            ids = part.column(0).to_numpy()
            row, found, score, _ = index.seeded(ids, _matrix(part.column(1), dims), k)
            yield emit(hit, pa.array(ids[row]), pa.array(found), pa.array(score))

    out = "query_id long, vec_id long, score double"
    found = blocks.join(chunks, "list").select("ids", "block", "query_ids", "queries").mapInArrow(search, out)
    found = found.union(asking.mapInArrow(seeded, out)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packer(rows: int, dims: int):
    """Pack sorted (list, id, vector) rows into one row of bytes per list and at most ``rows`` of them."""
    schema = pa.schema([("list", pa.int32()), ("ids", pa.binary()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, ids, block = np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, dims))

        def packed(a: int, b: int) -> pa.RecordBatch:
            return emit(schema, [int(lists[a])], [ids[a:b].tobytes()], [block[a:b].tobytes()])

        for batch in batches:
            lists = np.concatenate([lists, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, batch.column(1).to_numpy()])
            block = np.concatenate([block, _matrix(batch.column(2), dims)])
            while len(lists):
                end = min(int(np.searchsorted(lists, lists[0], "right")), rows)
                if end == len(lists) and end < rows:
                    break  # the list may go on in the next batch
                yield packed(0, end)
                lists, ids, block = lists[end:], ids[end:], block[end:]
        if len(lists):
            yield packed(0, len(lists))

    return run
