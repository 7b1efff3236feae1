"""Line deduplication by a deletion-neighbourhood join.

A line is a duplicate if an earlier line, in order of (doc_id, hash of the text,
line number), is equal to it or, from ``min_words`` words on, at most one edit away: one word put
in, left out or replaced. Lines are compared lower-cased (A-Z) with single
blanks; lines without a word are never duplicates.

1. Equal lines collapse to their first occurrence (128-bit hash, pre-aggregated).
2. Lines that can have a partner at all: after one edit, either half of a line is
   still whole. Two keys for the line's own length and two for the next shorter
   one let every partner meet; only lines that share a half go on, which loses
   none.
3. Those emit their deletion neighbourhood as hashed keys: the line itself and
   the line without its i-th word, for every i. Equal keys join. Lines that
   become equal by deleting at the same place are one replacement apart, so the
   earliest of such a group stands for all its pairs; a line equal to another's
   variant is one insertion away. No pairs within a group are made.
4. Candidates are verified word by word, and the earliest line is kept.

Hashes of a line without a block come from prefix sums of a polynomial over the
words, modulo three primes, so a text of any length takes time in proportion to
its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices, text_mark, unused, utf8
from tessera.session import materialize

#: Below six words, lines of one text in another's words meet by chance (README has the counts for 2 to 10).
MIN_WORDS = 6
# The polynomial's moduli and base.
_PRIMES = np.array([2147483647, 2147483629, 2147483587], np.uint64)
_BASE = 1_103_515_245
_SIGN = 1 << 63


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


class Powers:
    """base^i and base^-i modulo each prime, grown on demand."""

    def __init__(self):
        self.up = np.ones((3, 1), np.uint64)
        self.down = self.up.copy()

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = _PRIMES[:, None]
        while self.up.shape[1] <= n:
            size = self.up.shape[1]
            up = np.array([[pow(_BASE, size, int(q))] for q in _PRIMES], np.uint64)
            down = np.array([[pow(_BASE, -size, int(q))] for q in _PRIMES], np.uint64)
            self.up = np.concatenate([self.up, self.up * up % p], axis=1)
            self.down = np.concatenate([self.down, self.down * down % p], axis=1)
        return self.up, self.down


class Hashed:
    """Hashes of stretches of a word sequence."""

    def __init__(self, words: list[bytes], powers: Powers):
        n = len(words)
        x = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, n)
        self.up, self.down = powers.to(n + 1)
        p = _PRIMES[:, None]
        terms = (x[None] % p + np.uint64(1)) % p * self.up[:, :n] % p
        self.sums = np.concatenate([np.zeros((3, 1), np.uint64), np.cumsum(terms, axis=1)], axis=1) % p  # n terms below 2^31 each

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(3, k): hash of words[a:b], moved to place 0."""
        p = _PRIMES[:, None]
        return (self.sums[:, b] + p - self.sums[:, a]) % p * self.down[:, a] % p

    def without(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(3, k): hash of words[start:a] followed by words[b:end]."""
        p = _PRIMES[:, None]
        return (self.stretch(start, a) + self.stretch(b, end) * self.up[:, a - start]) % p


def _long(*parts: np.ndarray) -> np.ndarray:
    """Mix non-negative numbers below 2^62 into one signed long."""
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = (out ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


LINES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("line_no", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()),
                   ("k0", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("k3", pa.int64())])


def _halves(words: list[bytes]) -> list[int]:
    """Keys of the halves of a line, signed: (first, second) for its own length, then for one word less."""
    out, n = [], len(words)
    for size in (n, n - 1):
        half = size // 2
        out.append(xxhash.xxh64_intdigest(b" ".join(words[:half]), 2 * size) - _SIGN)
        out.append(xxhash.xxh64_intdigest(b" ".join(words[n - size + half:]), 2 * size + 1) - _SIGN)
    return out


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line with a word: its place (doc_id, mark of the text, line number), 128-bit hash, number of words and half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            ids, marks, numbers, digests, sizes, keys = [], [], [], [], [], []
            for doc_id, mark, text in zip(*(c.to_pylist() for c in part.columns)):
                for number, line in enumerate((text or b"").lower().split(b"\n")):
                    if found := line.split():
                        ids.append(doc_id)
                        marks.append(mark)
                        numbers.append(number)
                        sizes.append(len(found))
                        digests.append(xxhash.xxh3_128_digest(b" ".join(found)))
                        keys += _halves(found)
            if ids:
                ab, four = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), np.array(keys, np.int64).reshape(-1, 4)
                yield emit(LINES, ids, marks, numbers, pa.array(ab[:, 0]), pa.array(ab[:, 1]), sizes, *(pa.array(np.ascontiguousarray(four[:, k])) for k in range(4)))

    return docs.select(col(id_col).cast("long"), text_mark(text_col), utf8(text_col)).mapInArrow(
        run, "doc_id long, mark long, line_no int, a long, b long, n int, k0 long, k1 long, k2 long, k3 long")


def _partners(distinct: DataFrame, min_words: int) -> DataFrame:
    """Of the distinct lines, those that share a half with another line in a length that allows one edit."""
    keys = distinct.where(F.col("n") >= min_words).select("a", "b", "first", F.explode(F.array(*(
        F.struct(F.col(k).alias("k"), F.lit(own).alias("own")) for k, own in (("k0", 1), ("k1", 1), ("k2", 0), ("k3", 0))))).alias("e"))
    keys = keys.select("a", "b", "first", "e.k", "e.own")
    shared = keys.groupBy("k").agg(F.count("*").alias("rows"), F.sum("own").alias("owned")).where("rows > 1 AND owned > 0").select("k")
    shared = materialize(shared, "shared-halves")
    return keys.join(shared.hint("merge"), "k", "left_semi").select("a", "b", "first").distinct()


def neighbourhood(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (u, v) and places of a line and of all its one-word deletions; the line itself has place -1."""
    words = text.split(b" ")
    n = len(words)
    h = Hashed(words, powers)
    at = np.arange(n)
    zero, end = np.zeros(n + 1, np.int64), np.full(n + 1, n)
    gone, after = np.concatenate([[n], at]), np.concatenate([[n], at + 1])
    x = h.without(gone, after, zero, end)
    size = np.concatenate([[n], np.full(n, n - 1)])
    return _long(x[0] << np.uint64(31) | x[1], size), _long(x[2], size), np.concatenate([[-1], at])


def one_edit(a: bytes, b: bytes) -> bool:
    """True if at most one word must be put in, left out or replaced."""
    x, y = a.split(b" "), b.split(b" ")
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    at = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    return x[at + (len(x) == len(y)):] == y[at + 1:]


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, doc_id, mark, line_no, text): the normal form of each wanted line, read at its first occurrence."""
    by_doc = wanted.groupBy(F.col("first.doc_id").alias("__doc"), F.col("first.mark").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("first.line_no", "a", "b"))).alias("__want"))
    found = docs.select(col(id_col).cast("long").alias("__id"), text_mark(text_col).alias("__mark"), utf8(text_col).alias("__text")).join(
        by_doc, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__mark") == F.col("__of"))).select("__id", "__mark", "__text", "__want")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("line_no", pa.int32()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, mark, text, want in zip(*(c.to_pylist() for c in part.columns)):
                all_lines = (text or b"").split(b"\n")
                for x in want:
                    # another text with the same mark may not hold the line
                    line = normal(all_lines[x["line_no"]]) if x["line_no"] < len(all_lines) else b""
                    if tuple(np.frombuffer(xxhash.xxh3_128_digest(line), "<i8").tolist()) == (x["a"], x["b"]):
                        rows.append((x["a"], x["b"], doc_id, mark, x["line_no"], line))
            if rows:
                yield emit(schema, *zip(*rows))

    return found.mapInArrow(run, "a long, b long, doc_id long, mark long, line_no int, text binary").dropDuplicates(["a", "b"])


def _variants(texts: DataFrame) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("place", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("line_no", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in slices(batches, 64):
            found = [neighbourhood(t, powers) for t in part.column(5).to_pylist()]
            times = np.array([len(x[0]) for x in found])
            own = [np.repeat(part.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1, 3, 4)]
            ids = part.column(2).take(pa.array(np.repeat(np.arange(len(found)), times)))
            u, v, place = (np.concatenate(x) for x in zip(*found))
            yield emit(schema, pa.array(u), pa.array(v), pa.array(place.astype(np.int32)), pa.array(own[0]), pa.array(own[1]), ids, pa.array(own[2]), pa.array(own[3].astype(np.int32)))

    return texts.mapInArrow(run, "u long, v long, place int, a long, b long, doc_id long, mark long, line_no int")


def _meeting(variants: DataFrame) -> DataFrame:
    """The variants whose key another line has too; most keys belong to one line and end here.

    The shared keys grow with the corpus, so here and above the join is a merge
    join at every size: one plan, whose hot keys Spark can split."""
    shared = variants.groupBy("u", "v").agg(*(f(c).alias(f"{c}{i}") for c in ("a", "b") for i, f in enumerate((F.min, F.max))))
    shared = materialize(shared.where("a0 <> a1 OR b0 <> b1").select("u", "v"), "shared-variants")
    return variants.join(shared.hint("merge"), ["u", "v"], "left_semi")


def _candidates(variants: DataFrame) -> DataFrame:
    """(a, b, c, d): line (a, b) has the earlier line (c, d) as the earliest of one of its groups."""
    me = F.struct("doc_id", "mark", "line_no", "a", "b")
    mine = variants.select("u", "v", "place", me.alias("me"))
    whole, cut = mine.where("place = -1").select("u", "v", F.col("me").alias("other")), mine.where("place >= 0")
    replaced = cut.groupBy("u", "v", "place").agg(F.min("me").alias("other"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    longer = cut.groupBy("u", "v").agg(F.min("me").alias("other"))
    pairs = cut.join(replaced, ["u", "v", "place"]).select("me", "other").union(
        cut.join(whole, ["u", "v"]).select("me", "other")).union(
        whole.withColumnRenamed("other", "me").join(longer, ["u", "v"]).select("me", "other"))
    return pairs.where("other < me").select("me.a", "me.b", F.col("other.a").alias("c"), F.col("other.b").alias("d")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the lines that are one edit from an earlier line."""
    mine = texts.select("a", "b", F.col("text").alias("x"))
    other = texts.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("text").alias("y"))
    both = pairs.join(mine, ["a", "b"]).join(other, ["c", "d"]).select("a", "b", "x", "y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            near = pa.array([one_edit(x, y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())], pa.bool_())
            yield emit(schema, *part.select([0, 1]).filter(near).columns)

    return both.mapInArrow(run, "a long, b long").distinct()


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, exact, near): for documents with duplicate lines the numbers (from 0) of those that equal an earlier
    line and of those that are one edit from one.

    Null and empty texts have no lines to compare. A null doc_id comes before
    all others, and texts that share an id come in order of mark, a hash of the
    text. Rows that repeat a doc_id and its text are one document with one answer;
    its lines are not duplicates of themselves. Other columns are not read.
    """
    every = materialize(lines(docs, id_col, text_col), "lines")
    distinct = every.groupBy("a", "b").agg(F.min(F.struct("doc_id", "mark", "line_no")).alias("first"), F.count("*").alias("rows"),
                                           *(F.max(k).alias(k) for k in ("n", "k0", "k1", "k2", "k3")))
    distinct = materialize(distinct, "distinct-lines")
    texts = materialize(_texts(docs, _partners(distinct, min_words), id_col, text_col), "line-texts")
    variants = materialize(_variants(texts), "line-variants")
    meeting = materialize(_meeting(variants), "meeting-variants")
    near = materialize(_verified(_candidates(meeting), texts), "near-lines").withColumn("near", F.lit(True))
    acting = distinct.where("rows > 1").select("a", "b", "first").join(near, ["a", "b"], "full").select(
        "a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    found = every.select("doc_id", "mark", "line_no", "a", "b").join(acting, ["a", "b"])
    again = ~F.struct("doc_id", "mark", "line_no").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    found = found.where(F.col("near") | again).select("doc_id", "mark", F.struct("line_no", again.alias("again")).alias("x"))
    found = found.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return found.select("doc_id", "mark", *(F.expr(f"transform(filter(x, e -> {which} e.again), e -> e.line_no)").alias(name)
                                    for name, which in (("exact", ""), ("near", "NOT"))))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, exact, near, n_kept) of every row of ``docs``: lines in all (a null text has none), the numbers
    of the duplicates, and how many lines stay."""
    found = duplicate_lines(docs, id_col, text_col, min_words).withColumnsRenamed({"doc_id": "__doc", "mark": "__of"})
    counted = docs.select(col(id_col).cast("long").alias("doc_id"), text_mark(text_col).alias("__mark"),
                          F.coalesce(F.regexp_count(col(text_col).cast("string"), F.lit("\n")) + 1, F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    out = counted.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__mark") == F.col("__of")), "left").select(
        "doc_id", "n_lines", F.coalesce("exact", none).alias("exact"), F.coalesce("near", none).alias("near"))
    return out.withColumn("n_kept", F.col("n_lines") - F.size("exact") - F.size("near"))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
                            min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all columns, their texts without duplicate lines and ``length_col``, if there is one, set to the new length.

    A document that had lines with words and keeps none of them goes; one that never had any stays as it is.
    """
    doc, of, lost = unused(docs, "doc", "of", "gone")
    found = duplicate_lines(docs, id_col, text_col, min_words).select(F.col("doc_id").alias(doc), F.col("mark").alias(of), F.concat("exact", "near").alias(lost))
    at, names = docs.columns.index(text_col), docs.columns
    joined = docs.join(found, col(id_col).cast("long").eqNullSafe(F.col(doc)) & (text_mark(text_col) == F.col(of)), "left").select(*[col(c) for c in names], lost)
    length = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, stay = part.column(at).to_pylist(), []
            lengths = None if length is None else part.column(length).to_pylist()
            for i, (text, gone) in enumerate(zip(texts, part.column(len(names)).to_pylist())):
                if gone:
                    gone = set(gone)
                    left = [x for k, x in enumerate(texts[i].split("\n")) if k not in gone]
                    texts[i] = "\n".join(left)
                    if lengths is not None:
                        lengths[i] = len(texts[i])
                stay.append(not gone or any(x.encode("utf-8", "surrogatepass").split() for x in left))
            columns = list(part.columns)[: len(names)]
            columns[at] = pa.array(texts, part.schema.field(at).type)
            if length is not None:
                columns[length] = pa.array(lengths, part.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
