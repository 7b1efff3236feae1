"""Language-model scoring by prediction by partial matching over byte contexts.

The model is a context trie of order ``ORDER`` counted over the training texts: a
node is a context of up to that many bytes, its children are the bytes that
followed, with their counts. A byte is coded at the longest context seen in
training; a context with total n and q distinct followers gives a follower of
count c the probability c / (n + q) and escapes to the next shorter one with
q / (n + q). Followers of the longer context are excluded from the shorter one.
Behind the shortest context all byte values not yet excluded are equally likely.
Two values that UTF-8 never uses stand for the end of a text and for what lies
before its beginning.

With a trained trie the followers of a longer context are among those of the
shorter one, so what exclusion leaves of a context (its total and distinct
followers less those of the longer context) is the same for all texts, and the
code length of a byte depends on its context alone. So the trie is a table with
one row per (context, byte):

1. A task collects blocks of texts, their distinct (context, byte) numbers and
   words, each with its occurrences in training texts.
2. Spark sums them; shorter contexts are sums over longer ones. From the empty
   context upwards, every row takes its parent's values by a join on the shorter
   number, and a window over the followers of one context (256 at most) gives n, q
   and the excluded count.
3. Code lengths and word counts return to the blocks that asked for them, and
   each text adds its own up. A context or word of a third of all texts is one
   row a block.

The trie grows with the corpus and is never held whole by a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices, utf8
from tessera.session import materialize

ORDER = 4
BLOCK = 32 << 20
#: Bytes of text whose contexts are numbered at a time.
_SLICE = 1 << 21
_BEFORE, _END = b"\xfe", b"\xff"
#: The end of a text among its words: no word holds a blank.
_LAST = b"\n"


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) numbers of all texts, each with its end, and where each text's numbers end.

    A number has the byte in its lowest eight bits, the byte before it in the next, and so on.
    """
    text = np.frombuffer(b"".join(_BEFORE * order + t + _END for t in texts), np.uint8)
    number = np.zeros(len(text) - order, np.int64)
    for i in range(order + 1):
        number <<= 8
        number |= text[i: len(text) - order + i]
    return number[(text != 0xFE)[order:]], np.cumsum([len(t) + 1 for t in texts])


class _Needs:
    """What a block asks for: distinct numbers and words, with their occurrences in training texts."""

    def __init__(self, order: int):
        self.order, self.size = order, 0
        self.numbers, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.words: Counter[bytes] = Counter()

    def add(self, texts: list[bytes], held: list[bool]) -> None:
        for kind in (False, True):
            some = [t for t, h in zip(texts, held) if h is kind]
            if not some:
                continue
            number, n = np.unique(grams(some, self.order)[0], return_counts=True)
            every, at = np.unique(np.concatenate([self.numbers, number]), return_inverse=True)
            counts = np.zeros(len(every), np.int64)
            counts[at[: len(self.numbers)]] = self.counts
            if not kind:
                counts[at[len(self.numbers):]] += n
            self.numbers, self.counts = every, counts
            for t in some:
                if kind:
                    for word in {*t.split(), _LAST}:
                        self.words[word] += 0
                else:
                    self.words.update(t.split())
                    self.words[_LAST] += 1
        self.size += sum(map(len, texts))


def _collected(docs: DataFrame, order: int, block: int) -> DataFrame:
    """Rows of three kinds, by block: packed slices of texts, numbers and words."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
                        ("texts", pa.binary()), ("number", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, needs = TaskContext.get().partitionId() << 32, _Needs(order)

        def row(ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
            needs.add(texts, held)
            packed = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            return emit(schema, [number], [ids], [held], [[len(t) for t in texts]], [packed], [None], [None], [None])

        def closed() -> Iterator[pa.RecordBatch]:
            words = [*needs.words.items()]
            for x in range(0, len(needs.numbers), 1 << 15):
                some = needs.numbers[x: x + (1 << 15)]
                yield emit(schema, np.full(len(some), number), *(pa.nulls(len(some), t) for t in schema.types[1:5]), some, pa.nulls(len(some), pa.binary()),
                           needs.counts[x: x + (1 << 15)])
            for x in range(0, len(words), 1 << 13):
                some = words[x: x + (1 << 13)]
                yield emit(schema, [number] * len(some), *(pa.nulls(len(some), t) for t in schema.types[1:6]), [w for w, _ in some], [n for _, n in some])

        for part in slices(batches):
            ids, held, texts = (c.to_pylist() for c in part.columns)
            texts, at = [(t or b"").lower() for t in texts], 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and size < _SLICE:
                    size += len(texts[to])
                    to += 1
                yield row(ids[at:to], held[at:to], texts[at:to])
                at = to
                if needs.size >= block:
                    yield from closed()
                    number, needs = number + 1, _Needs(order)
        yield from closed()

    kept = docs.mapInArrow(run, "block long, ids array<long>, held array<boolean>, sizes array<long>, texts binary, number long, word binary, n long")
    return materialize(kept, "contexts")


def code_lengths(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(number, v): log10 of the model's probability of each (context, byte) of ``counted`` (number, n).

    n is the number's occurrences in training texts, 0 for one that is only asked for.
    """
    levels = [counted.select("number", F.col("n").alias("c"))]
    for size in range(order, 0, -1):
        shorter = F.col("number").bitwiseAND((1 << 8 * size) - 1)
        levels.append(materialize(levels[-1].groupBy(shorter.alias("number")).agg(F.sum("c").alias("c")), "trie"))
    rows = None
    for k, level in enumerate(reversed(levels)):
        followers = Window.partitionBy("context")
        level = level.withColumn("context", F.shiftright("number", 8))
        if k:
            parent = rows.select(F.col("number").alias("up"), *(F.col(x).alias(f"p_{x}") for x in ("c", "n", "q", "r", "v")))
            level = level.join(parent, F.col("number").bitwiseAND((1 << 8 * k) - 1) == F.col("up"))
        seen = F.col("c") > 0
        level = level.withColumn("n", F.sum("c").over(followers)).withColumn("q", F.sum(seen.cast("long")).over(followers))
        if k:
            level = level.withColumn("x", F.sum(F.when(seen, F.col("p_c")).otherwise(F.lit(0))).over(followers))
            left = F.col("p_q") - F.col("q")
            total = F.col("p_n") - F.col("x") + left
            escape = F.when(left > 0, _log(left, total)).otherwise(F.lit(0.0))
            rest = F.when(F.col("p_c") > 0, _log(F.col("p_c"), total)).otherwise(escape + F.col("p_r"))
            unseen = F.col("p_v")
        else:
            rest, unseen = -F.log10(256 - F.col("q")), F.lit(float(-np.log10(256)))
        level = level.withColumn("r", rest)
        total = F.col("n") + F.col("q")
        value = F.when(F.col("n") == 0, unseen).when(seen, _log(F.col("c"), total)).otherwise(_log(F.col("q"), total) + F.col("r"))
        rows = materialize(level.withColumn("v", value).select("number", "c", "n", "q", "r", "v"), "trie")
    return rows.select("number", "v")


def _log(a: Column, b: Column) -> Column:
    return F.log10(F.try_divide(a.cast("double"), b.cast("double")))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block: int = BLOCK, parts: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``.

    held_out: crc32 of the id as text is a multiple of ``parts``; the others train.
    A null id is not held out. Texts are lower-cased (A-Z). score is the log10
    probability of the text's bytes and its end under the trained trie; base_score
    that of its words and its end under smoothed word frequencies. A null text
    counts as empty: its end is its one token. Repeated rows train and are scored
    each for itself. Without training texts every byte has probability 1/256. An
    empty table gives an empty result; other columns are not read. A task holds about ``block`` bytes of
    text, or one longer text, packed.
    """
    held = F.coalesce(F.crc32(col(id_col).cast("long").cast("string")) % parts == 0, F.lit(False))
    kept = _collected(docs.select(col(id_col).cast("long").alias("doc_id"), held.alias("held"), utf8(text_col).alias("text")), order, block)
    texts = kept.where("texts IS NOT NULL").select("block", "ids", "held", "sizes", "texts")
    numbers = kept.where("number IS NOT NULL").select("block", "number", "n")
    words = kept.where("word IS NOT NULL").select("block", "word", "n")

    valued = code_lengths(materialize(numbers.groupBy("number").agg(F.sum("n").alias("n")), "trie"), order)
    lengths = numbers.select("block", "number").join(valued, "number")
    same = Window.partitionBy("word")
    counted = words.select("block", "word", F.sum("n").over(same).alias("n"), (F.col("block") == F.min("block").over(same)).alias("first"))
    counted = materialize(counted, "word-counts")
    tokens = counted.where("first").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    below = tokens.n + 0.1 * (tokens.v + 1)
    found = lengths.select(F.col("block").alias("home"), "number", F.lit(None).cast("binary").alias("word"), "v", F.lit(None).cast("long").alias("n")).unionByName(
        counted.select(F.col("block").alias("home"), F.lit(None).cast("long").alias("number"), "word", F.lit(None).cast("double").alias("v"), "n"))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])

    def total(texts: pa.Table, found: pa.Table) -> pa.Table:
        mine = found.filter(pa.compute.is_valid(found.column("number")))
        number, value = mine.column("number").to_numpy(), mine.column("v").to_numpy()
        value = value[by := np.argsort(number)]
        number = number[by]
        named = found.filter(pa.compute.is_valid(found.column("word")))
        n = named.column("n").to_numpy()
        known = dict(zip(named.column("word").to_pylist(), zip(np.log10((n + 0.1) / below).tolist(), (n > 0).tolist())))
        rows = []
        for part in texts.to_batches():
            for ids, held, sizes, packed in zip(*(part.column(x).to_pylist() for x in ("ids", "held", "sizes", "texts"))):
                whole, to = pa.decompress(packed, sum(sizes), codec="zstd", asbytes=True), np.cumsum(sizes).tolist()
                some = [whole[x - n: x] for x, n in zip(to, sizes)]
                asked, ends = grams(some, order)
                sums = np.add.reduceat(value[np.searchsorted(number, asked)], np.concatenate([[0], ends[:-1]]))
                for doc_id, out_of, text, s in zip(ids, held, some, sums.tolist()):
                    tokens_of = [known[w] for w in (*text.split(), _LAST)]
                    rows.append((doc_id, out_of, len(tokens_of), sum(k for _, k in tokens_of), tokens.n, sum(x for x, _ in tokens_of), s))
        return pa.table([list(c) for c in zip(*rows)] or [[] for _ in out.names], schema=out)

    return texts.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(
        total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
