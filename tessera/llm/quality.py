"""Quality rules whose cutoffs limit the false rejection of good documents.

Signals of every whole text (shares of symbols, capitals, exclamation marks,
repeated lines and repeated words, mean word length) are rounded down to levels.
Labelled documents are split by content into two halves:

* the design half proposes, per stratum, a path of ever stricter cutoffs: at
  step t no signal may cost more than a given share of the good documents, and a
  signal takes part only where it meets bad documents far more often;
* the holdout half tests the path. At each step the number of good holdout
  documents that any signal rejects is compared with the exact binomial
  distribution at the allowed rate ``alpha``. Steps are tested in order and only
  while the test holds (fixed sequence), at level ``delta`` / number of strata
  (Bonferroni), so with confidence 1 - ``delta`` every stratum loses at most
  ``alpha`` of its good documents.

A stratum with too few labels to prove anything rejects nothing beyond the base
rules. Labels are only counted: what reaches the driver is one number per
stratum, signal and level.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices, utf8
from tessera.session import materialize

SYMBOLS = b"#*$%&|<>"
_BLANK, _UPPER, _LOWER = b" \t\n\r\x0b\x0c", bytes(range(65, 91)), bytes(range(97, 123))
WINDOW = 8
LEVELS = 200
#: Shares of the good design documents that one signal may cost, step by step.
STEPS = 8
ALPHA, DELTA = 0.01, 0.05
#: A signal counts where the share of bad documents beyond its cutoff is this many times that of good ones.
LIFT = 5.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    x = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + x[k: k + n]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    same = defaultdict(list)  # equal hashes are compared word by word
    for at in np.flatnonzero(np.isin(key, twice)).tolist():
        same[tuple(words[at: at + window])].append(at)
    edge = np.zeros(len(words) + 1, np.int64)
    for places in same.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, np.array(places) + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def count(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text; all zero for null."""
    text = text or b""
    words = text.split()
    bare = text.translate(None, _BLANK)
    follow = 0 if bare.isascii() else int(np.count_nonzero((np.frombuffer(bare, np.uint8) & 0xC0) == 0x80))
    seen, again, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.translate(None, _BLANK):
            lines += 1
            again += line in seen
            seen.add(line)
    without = lambda drop: len(bare) - len(bare.translate(None, drop))
    upper = without(_UPPER)
    return (len(words), len(bare) - follow, without(SYMBOLS), again, repeated_words(words), lines, upper, upper + without(_LOWER), without(b"!"))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, mark, COUNTS...) of every row; mark is a hash of the text, a null stratum is ''."""
    schema = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), ("mark", pa.int64()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield emit(schema, *part.columns[:3], *zip(*map(count, part.column(3).to_pylist())))

    mark = F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))
    return docs.select(col(id_col).cast("long"), F.coalesce(col(stratum_col).cast("string"), F.lit("")), mark, utf8(text_col)).mapInArrow(
        run, "doc_id long, stratum string, mark long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The level of each signal, 0 to LEVELS; a document is rejected from a cutoff on."""
    def level(part: str, whole: str, scale: float = LEVELS) -> Column:
        return F.least(F.lit(LEVELS), F.floor(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * scale)).cast("int")

    mean = level("word_chars", "n_words", LEVELS / 40)
    return {"symbols": level("n_symbols", "n_words"), "capitals": level("n_upper", "n_letters"), "marks": level("n_marks", "n_words"),
            "lines": level("n_dup_lines", "n_lines"), "repeats": level("n_repeat_words", "n_words"), "long": mean, "short": F.lit(LEVELS) - mean}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exact up to rounding."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(min(k, n) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def propose(good: np.ndarray, bad: np.ndarray, alpha: float = ALPHA, steps: int = STEPS) -> list[int]:
    """Cutoff of one signal at each step, from counts by level; LEVELS + 1 rejects nothing.

    At a step the good documents at or above the cutoff are at most its share;
    the cutoff then moves half way to the median of the bad ones beyond it.
    """
    out, last = [], LEVELS + 1
    above_good = np.append(np.cumsum(good[::-1])[::-1], 0)
    above_bad = np.append(np.cumsum(bad[::-1])[::-1], 0)
    for step in range(steps):
        share = alpha / 4 * step / max(1, steps - 1)
        least = max(1, int(np.argmax(above_good <= share * good.sum())))
        if above_bad[least]:
            median = int(np.flatnonzero(above_bad * 2 >= above_bad[least])[-1])
            cut = max(least, (least + median + 1) // 2)
            if above_bad[cut] * max(1, good.sum()) >= LIFT * max(1, above_good[cut]) * bad.sum():
                last = min(last, cut)
        out.append(last)
    return out


def choose(rejected: list[int], n: int, strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Number of steps of the path that hold: ``rejected`` has the good holdout documents lost up to each step."""
    held = 0
    for k in rejected:
        if not n or binomial_tail(k, n, alpha) > delta / strata:
            break
        held += 1
    return held


def calibrate(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, label_col: str = "quality",
              id_col: str = "doc_id") -> dict[str, tuple[list[list[int]], int]]:
    """Per stratum the cutoffs of each rule by step and the number of steps that hold.

    Only documents that pass the base rules count; equal texts count once, as
    bad if any of their labels is 0. Null labels count for nothing.
    """
    names = rules()
    label = labels.select(col(id_col).cast("long").alias("__id"), col(label_col).cast("int").alias("good")).where("good IS NOT NULL")
    labelled = counted.where(~base_failed()).join(label, F.col("doc_id") == F.col("__id")).select("stratum", "mark", "good", *(x.alias(n) for n, x in names.items()))
    labelled = labelled.groupBy("stratum", "mark").agg(F.min("good").alias("good"), *(F.first(n).alias(n) for n in names))
    labelled = materialize(labelled.withColumn("design", F.pmod(F.xxhash64(F.lit("half"), "mark"), F.lit(2)) == 0), "labelled")

    levels = labelled.where("design").select("stratum", "good", F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), F.col(n).alias("level")) for r, n in enumerate(names)))).alias("x"))
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((2, len(names), LEVELS + 1), np.int64))
    for r in levels.groupBy("stratum", "good", "x.rule", "x.level").count().collect():
        seen[r.stratum][int(r.good > 0), r.rule, r.level] += r["count"]
    paths = {s: [propose(x[1, r], x[0, r], alpha) for r in range(len(names))] for s, x in seen.items()}

    lost: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(STEPS + 1, np.int64))
    for r in with_step(labelled.where("NOT design AND good > 0"), paths).groupBy("stratum", "step").count().collect():
        lost[r.stratum][r.step] += r["count"]
    return {s: (path, choose(np.cumsum(lost[s])[:STEPS].tolist(), int(lost[s].sum()), len(paths), alpha, delta)) for s, path in paths.items()}


def with_step(levelled: DataFrame, paths: dict[str, list[list[int]]]) -> DataFrame:
    """Add the first step whose cutoffs reject a row, STEPS if none does. The paths are one small row per stratum."""
    spark = levelled.sparkSession
    names = [*rules()]
    table = spark.createDataFrame([(s, path) for s, path in paths.items()], "__stratum string, __path array<array<int>>")
    joined = levelled.join(F.broadcast(table), F.col("stratum") == F.col("__stratum"), "left")
    # cutoffs only fall along a path, so those above a level are the steps before its first rejection
    first = [F.expr(f"size(filter(element_at(__path, {r + 1}), cut -> cut > `{n}`))") for r, n in enumerate(names)]
    return joined.withColumn("step", F.when(F.col("__path").isNull(), F.lit(STEPS)).otherwise(F.least(*first))).drop("__stratum", "__path")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, COUNTS..., base_failed, step, kept) of every row of ``docs``.

    kept is false if the base rules fail (under 20 words, or over 30 % of the
    words in repeated windows) or if the calibrated cutoffs reject the document;
    step is the first step of its stratum's path that would. Null texts have no
    words and fail. Without labels only the base rules decide. Repeated rows stay
    repeated, empty tables give an empty result.
    """
    counted = materialize(signals(docs, id_col, text_col, stratum_col), "signals")
    model = calibrate(counted, labels, alpha, delta)
    levelled = with_step(counted.select("*", *(x.alias(n) for n, x in rules().items())), {s: path for s, (path, _) in model.items()})
    held = docs.sparkSession.createDataFrame([(s, k) for s, (_, k) in model.items()], "__stratum string, __held int")
    levelled = levelled.join(F.broadcast(held), F.col("stratum") == F.col("__stratum"), "left")
    rejected = F.col("step") < F.coalesce("__held", F.lit(0))
    return levelled.select("doc_id", *COUNTS, base_failed().alias("base_failed"), "step", (~base_failed() & ~rejected).alias("kept"))
