"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set where more than half of its shingle
hashes have it. Fingerprints within ``radius`` differing bits are linked, and a
group is a connected component of those links.

1. Copies collapse: one row per distinct fingerprint goes on.
2. Candidate blocks: the 64 bits are cut into ``radius + m`` runs; two
   fingerprints within the radius agree on at least ``m`` runs, so every choice
   of ``m`` runs is one table of buckets and no link is missed. ``m`` follows the
   number of distinct fingerprints, so that a bucket stays a block of a few
   thousand however large the corpus is; any ``m`` gives the same links.
3. Inside a bucket the fingerprints are stored as 64 vertical bit planes, 64
   candidates to a machine word. A query XORs eight planes at a time into
   carry-save counters (ones, twos, fours, overflow) for all 64 lanes at once and
   gives a word up as soon as all its lanes exceed the radius.
4. A bucket yields the spanning star of its links, not its pairs; buckets above
   ``TILE`` are cut into tile pairs that different tasks compare.
5. Stars are joined to components by alternating large-star and small-star
   rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices, text_mark, utf8
from tessera.session import materialize

#: A bucket with more fingerprints than this is compared as pairs of tiles.
TILE = 16_384
#: Tables are chosen so that a bucket of evenly spread fingerprints holds at most this many.
BUCKET = 4_096
_WORDS = 1 << 15  # (query, candidate word) pairs handled at a time
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for a text without words or null."""
    words = (text or b"").lower().split()  # on bytes both know ASCII only
    n = len(words)
    if not n:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return hashed(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    total = n - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[at: at + (1 << 16)], ends[at: at + (1 << 16)])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # bytes cannot overflow within 255 rows
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp): the hash of the text, and the fingerprint as the signed long with the same bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in part.column(2).to_pylist()], np.uint64)
            yield emit(schema, *part.columns[:2], pa.array(fp.view(np.int64)))

    return docs.select(col(id_col).cast("long"), text_mark(text_col), utf8(text_col)).mapInArrow(run, "doc_id long, mark long, fp long")


def sliced_links(fps: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j), i < j, within each block of ``fps``; block b is fps[starts[b]:starts[b + 1]].

    ``radius`` is at most 7, what the carry-save counters can hold.
    """
    sizes = np.diff(starts)
    words = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(words)])
    block = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(fps)) - starts[:-1][block]
    lane = first_word[:-1][block] * 64 + inside
    bits = np.zeros((first_word[-1] * 64, 64), np.uint8)
    bits[lane] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)  # plane b, word w: bit b of 64 candidates
    del bits
    used = np.zeros(first_word[-1] * 64, np.uint8)
    used[lane] = 1
    used = np.packbits(used, bitorder="little").view(np.uint64)
    owner = np.full(first_word[-1] * 64, -1, np.int64)
    owner[lane] = np.arange(len(fps))
    # a query meets the words of its block from its own word on
    own_word = lane // 64
    count = first_word[1:][block] - own_word
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _WORDS, "right")) - 1)
        q = np.repeat(np.arange(at, to), count[at:to])
        w = own_word[q] + (np.arange(len(q)) + bounds[at] - bounds[q])
        at = to
        ones = np.zeros(len(q), np.uint64)
        twos, fours = ones.copy(), ones.copy()
        later = np.where(w == own_word[q], ~((np.uint64(2) << (lane[q] % 64).astype(np.uint64)) - np.uint64(1)), _FULL)
        over = ~(used[w] & later)  # lanes without a candidate to compare start as given up
        for plane in range(0, 64, 8):
            mine = fps[q]
            d = [planes[b][w] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & np.uint64(1))) for b in range(plane, plane + 8)]
            ones, t1 = _add(ones, d[0], d[1])
            ones, t2 = _add(ones, d[2], d[3])
            twos, u1 = _add(twos, t1, t2)
            ones, t1 = _add(ones, d[4], d[5])
            ones, t2 = _add(ones, d[6], d[7])
            twos, u2 = _add(twos, t1, t2)
            fours, eights = _add(fours, u1, u2)
            over |= eights | _above(ones, twos, fours, radius)
            left = np.flatnonzero(over != _FULL)  # the other words are abandoned
            if len(left) < len(q):
                q, w, ones, twos, fours, over = (x[left] for x in (q, w, ones, twos, fours, over))
            if not len(q):
                break
        if len(q):
            row, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[row], owner[w[row] * 64 + bit]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adder over 64 lanes: sum and carry."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, same = np.zeros_like(ones), np.full_like(ones, _FULL)
    for k, x in ((4, fours), (2, twos), (1, ones)):
        if radius & k:
            same &= x
        else:
            above |= same & x
            same &= ~x
    return above


def _roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position linked with each of n positions."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (further := root[root]).tobytes() != root.tobytes():
                root = further
    return root


def _runs(radius: int, distinct: int) -> tuple[list[tuple[int, int]], int]:
    """(first bit, bits) of each run and the number m of runs that a table takes."""
    for m in range(1, 64 - radius):
        n = radius + m
        cuts = [64 * i // n for i in range(n + 1)]
        if distinct >> (m * 64 // n) <= BUCKET or n >= 10:
            return [(a, b - a) for a, b in zip(cuts, cuts[1:])], m
    raise ValueError("radius too large")


def _keys(fp: Column, runs: list[tuple[int, int]], m: int) -> Column:
    """One (t, key) for every choice t of m runs."""
    out = []
    for t, chosen in enumerate(combinations(runs, m)):
        key = F.lit(0).cast("long")
        for first, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)))
        out.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.array(*out)


def links(distinct: DataFrame, radius: int = 4, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(a, b): links that span each group of the distinct fingerprints ``fp``."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7")
    runs, m = _runs(radius, distinct.count() if blocks is None else blocks)
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), runs, m)).alias("k")).select("fp", "k.t", "k.key")
    large = keyed.groupBy("t", "key").count().where(F.col("count") > tile).select(
        "t", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(large, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = dealt.select("t", "key", "fp", mine.alias("x"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("y"))
    dealt = dealt.select("t", "key", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "fp")
    by = ["t", "key", "x", "y"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fp in _whole_blocks(batches):
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            sizes = np.diff(starts)
            alone = np.repeat(sizes == 1, sizes)  # most buckets hold one fingerprint and need no comparison
            fp, starts = fp[~alone], np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
            if len(fp):
                root = _roots(len(fp), sliced_links(fp, starts, radius))
                linked = np.flatnonzero(root != np.arange(len(fp)))
                yield emit(schema, pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64)))

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Regroup sorted rows so that no block is split; a block has at most two tiles of rows."""
    kept: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        fp = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        if kept is not None:
            keys, fp = np.concatenate([kept[0], keys]), np.concatenate([kept[1], fp])
        if not len(fp):
            continue
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield keys[:cut], fp[:cut]
        kept = keys[cut:], fp[cut:]
    if kept is not None and len(kept[1]):
        yield kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds; a round is two pre-aggregated
    minima joined back to the edges, so a node with any number of neighbours is
    split like any other skewed join. Rounds end when the edges stay the same.
    """
    edges, before = materialize(edges, "links"), None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.*").where("a <> b").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b"), F.col("b")).distinct())
        before = now


def _rooted(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root) of each distinct fingerprint: its first (no_id, doc_id, mark), null ids last, and the smallest fingerprint of its group."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("first")
    distinct = materialize(marked.groupBy("fp").agg(first), "distinct-fingerprints")
    group = components(links(distinct, radius))
    return distinct.join(group, distinct.fp == group.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links, a document's own
    included. Null and wordless texts have fingerprint zero and link like any
    other. Repeated rows stay repeated; a null doc_id is never the smallest
    unless its whole group has none. An empty table gives an empty result; other
    columns are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    rooted = _rooted(marked, radius)
    smallest = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
               seed: int = 42) -> DataFrame:
    """Rows of ``docs`` that stay: one document of each group, that with the smallest id, null ids last, and among
    texts that share it the one with the smallest hash.

    Rows that repeat an id and its text count as one document. All columns are
    kept, whatever their names.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    stay = _rooted(marked, radius).groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("stay"), F.col("first.mark").alias("of"))
    rows = docs.select(F.struct("*").alias("doc"), col(id_col).cast("long").alias("id"), text_mark(text_col).alias("mark"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stay")) & (F.col("mark") == F.col("of")), "left_semi").dropDuplicates(["id", "mark"])
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
