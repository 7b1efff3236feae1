"""BPE encoding through a minimal acyclic transducer of frequent words.

1. Words (runs without white space, after the tokenizer's normalization) are
   counted over all documents; partial counts are bounded per task and summed by
   Spark.
2. The most frequent ones, at most ``lexicon_size``, are encoded once and
   compiled into a minimal acyclic automaton: equal suffixes share states, and each transition
   carries how many words sort before its branch, so the sum along a path is the
   word's number and selects its ids. Its size is bounded by ``lexicon_size``,
   not by the corpus.
3. The compiled file lies in the shared folder; Spark hands it to each executor,
   which memory-maps it. New executors fetch it again.
4. Texts are cut into words; words found in the transducer take its ids, unseen
   ones are merged exactly by rank. Special tokens written in a text are kept
   as the tokenizer keeps them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices
from tessera.session import materialize, scratch_path

LEXICON = 65_536
#: Words a task counts or remembers before it passes its counts on or forgets.
_HELD = 300_000
#: Counts from here on are one level when the lexicon's least count is sought.
_MANY = 1 << 20

# The tokenizer's pieces of a word, and the blanks that Python's split() takes and \s does not.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BEYOND = re.compile("[^\x00-\u024f]")
_WORDS = regex.compile(r"\S+")
_NEVER = 1 << 62
_WIDTHS = (8, 16, 32)  # bytes of the pieces that are merged side by side; longer ones are merged alone


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies show for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Tokenizer:
    """A word-end BPE tokenizer read from its JSON description."""

    def __init__(self, description: str):
        spec = json.loads(description)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in (vocab | self.specials).items():
            self.tokens[i] = token
        # left id << 32 | right id -> rank << 32 | merged id
        self.merges = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(spec["model"]["merges"])}
        shown = byte_letters()
        self.inner = [vocab[shown[b]] for b in range(256)]
        self.last = [vocab[shown[b] + self.end] for b in range(256)]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        order = np.argsort(keys := np.fromiter(self.merges, np.int64, len(self.merges)))
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.merges.values(), np.int64, len(self.merges))[order]
        self.pieces = regex.compile(PIECES)
        self.library = tokenizers.Tokenizer.from_str(description)
        self.split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(PIECES), "removed", invert=True)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")

    def words(self, text: str) -> list[str]:
        """The normalized words of a text without special tokens.

        Up to U+024F normalization is lower case and white space what Python knows, but for four separators; beyond,
        the tokenizer's own normalizer decides, as its tables may be of another Unicode version.
        """
        if text.isascii() or not _BEYOND.search(text):
            text = text.lower()
            return _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()
        return [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]

    def pieces_of(self, word: str) -> list[str]:
        if word.isascii() or not _BEYOND.search(word):
            return self.pieces.findall(word)
        return [p for p, _ in self.split.pre_tokenize_str(word)]

    def word_ids(self, word: str) -> list[int]:
        pieces = self.pieces_of(word)
        return self.piece_ids(pieces[0]) if len(pieces) == 1 else [x for p in pieces for x in self.piece_ids(p)]

    def piece_ids(self, piece: str) -> list[int]:
        """Exact merges: again and again the pair of lowest rank, leftmost first; only its neighbours change."""
        raw, rank = piece.encode(), self.merges.get
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > _WIDTHS[-1]:
            return self._merge_long(ids)
        pairs = [rank(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != _NEVER:
            at = pairs.index(best)
            ids[at: at + 2] = [best & 0xFFFFFFFF]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(ids[at - 1] << 32 | ids[at], _NEVER)
            if at < len(pairs):
                pairs[at] = rank(ids[at] << 32 | ids[at + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for a long piece: pairs wait in a heap by rank and place, tokens are linked to their neighbours."""
        rank, n = self.merges.get, len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(best, at) for at in range(n - 1) if (best := rank(ids[at] << 32 | ids[at + 1], _NEVER)) != _NEVER]
        heapq.heapify(heap)
        while heap:
            best, at = heapq.heappop(heap)
            right = after[at]
            if ids[at] < 0 or right >= n or rank(ids[at] << 32 | ids[right], _NEVER) != best:
                continue  # one of the two has been merged since
            ids[at], ids[right] = best & 0xFFFFFFFF, -1
            after[at] = end = after[right]
            if end < n:
                before[end] = at
                if (new := rank(ids[at] << 32 | ids[end], _NEVER)) != _NEVER:
                    heapq.heappush(heap, (new, at))
            if (left := before[at]) >= 0 and (new := rank(ids[left] << 32 | ids[at], _NEVER)) != _NEVER:
                heapq.heappush(heap, (new, left))
        return [x for x in ids if x >= 0]

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """``piece_ids`` of many pieces side by side, as bytes: one step merges the best pair of every piece."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        for low, high in zip((0, *_WIDTHS), _WIDTHS):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(which), 1 << 14):
                some = which[at: at + (1 << 14)]
                ids, n = self._merged([raw[i] for i in some.tolist()], lengths[some], high)
                for i, row, k in zip(some.tolist(), ids, n.tolist()):
                    out[i] = row[:k].tobytes()
        for i in np.flatnonzero(lengths > _WIDTHS[-1]).tolist():
            out[i] = np.array(self.piece_ids(pieces[i]), "<u4").tobytes()
        return out

    def _merged(self, raw: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(-1, width)
        ids = self.inner_ids[text]
        rows = np.arange(len(raw))
        ids[rows, lengths - 1] = self.last_ids[text[rows, lengths - 1]]
        columns = np.arange(width)
        pairs = self._ranks(ids[:, :-1], ids[:, 1:])
        pairs[columns[:-1] >= lengths[:, None] - 1] = _NEVER
        pairs = np.column_stack([pairs, np.full(len(raw), _NEVER)])  # a last column that never merges
        final, n = ids.astype("<u4"), lengths.copy()
        while len(rows):
            at = pairs.argmin(axis=1)
            best = pairs[np.arange(len(rows)), at]
            going = best != _NEVER
            if not going.all():
                final[rows[~going]] = ids[~going]
                rows, ids, pairs, at, best = rows[going], ids[going], pairs[going], at[going], best[going]
            if not len(rows):
                break
            n[rows] -= 1
            every, left = np.arange(len(rows)), n[rows]
            ids[every, at] = best & 0xFFFFFFFF
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > at[:, None]), width - 1), 1)
            pairs = np.take_along_axis(pairs, np.minimum(columns + (columns >= at[:, None]), width - 1), 1)
            before = np.flatnonzero(at > 0)
            pairs[before, at[before] - 1] = self._ranks(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < left - 1)
            pairs[after, at[after]] = self._ranks(ids[after, at[after]], ids[after, at[after] + 1])
        return final, n

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


# --- the transducer ---------------------------------------------------------------------------------------------

_HEAD = struct.Struct("<8sqqqq")
_MAGIC = b"MATRANS1"


def compile_transducer(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The minimal automaton of the distinct words, as one block of flat arrays.

    Words are added in byte order; once a branch is left its states are complete
    and are replaced by an equal state already registered.
    """
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    weight: list[int] = []  # words accepted from a state

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            weight.append(final + sum(weight[to] for _, to in arcs))
        return register[key]

    path: list[list] = [[False, []]]  # open states from the root: [final, arcs]
    previous = b""
    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        while len(path) > shared + 1:
            final, arcs = path.pop()
            path[-1][1].append((previous[len(path) - 1], freeze(final, arcs)))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        previous = word
    while len(path) > 1:
        final, arcs = path.pop()
        path[-1][1].append((previous[len(path) - 1], freeze(final, arcs)))
    root = freeze(*path[0])
    keys, targets, before = [], [], []
    for s, (final, arcs) in enumerate(states):
        seen = int(final)
        for label, to in arcs:
            keys.append(s << 8 | label)
            targets.append(to)
            before.append(seen)
            seen += weight[to]
    ids = [x for _, out in entries for x in out]
    starts = np.cumsum([0, *(len(out) for _, out in entries)])
    return b"".join([
        _HEAD.pack(_MAGIC, len(keys), len(states), len(entries), root), np.array(keys, "<i8").tobytes(), starts.astype("<i8").tobytes(),
        np.array(targets, "<i4").tobytes(), np.array(before, "<i4").tobytes(), np.array(ids, "<u4").tobytes(), np.array([x[0] for x in states], "u1").tobytes()])


class Transducer:
    """A compiled transducer, memory-mapped or in memory; many words are looked up side by side."""

    def __init__(self, block: np.ndarray):
        magic, arcs, states, words, self.root = _HEAD.unpack(block[: _HEAD.size].tobytes())
        if magic != _MAGIC:
            raise ValueError("not a transducer")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = block[at: at + n * np.dtype(kind).itemsize].view(kind)
            at += out.nbytes
            return out

        self.keys, self.starts = take("<i8", arcs), take("<i8", words + 1)
        self.targets, self.before, self.ids, self.final = take("<i4", arcs), take("<i4", arcs), take("<u4", int(self.starts[-1])), take("u1", states)
        self.bytes, self.ends = memoryview(np.ascontiguousarray(self.ids)).cast("B"), (4 * self.starts).tolist()

    @classmethod
    def open(cls, path: str) -> Transducer:
        return cls(np.memmap(path, np.uint8, "r"))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for a word that is not in the lexicon."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number, alive = np.full(len(words), self.root), np.zeros(len(words), np.int64), np.arange(len(words))
        if not len(self.keys):  # nothing but perhaps the empty word
            number[lengths > 0], alive = -1, alive[:0]
        depth = 0
        while len(alive := alive[lengths[alive] > depth]):
            key = state[alive] << 8 | text[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            number[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            state[alive] = self.targets[at]
            number[alive] += self.before[at]
            depth += 1
        return np.where((number >= 0) & (self.final[state] == 1), number, -1)

    def output(self, number: int) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers."""
        return bytes(self.bytes[self.ends[number]: self.ends[number + 1]])


# --- on Spark -----------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all whole texts; a task holds at most ``_HELD`` words and what one slice of texts adds."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen = Tokenizer(tokenizer), Counter()
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for span in tok.special.split(text or "")[::2]:
                    seen.update(tok.words(span))
            if len(seen) > _HELD:
                yield emit(schema, [*seen], [*seen.values()])
                seen = Counter()
        if seen:
            yield emit(schema, [*seen], [*seen.values()])

    counted = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", lexicon_size: int = LEXICON) -> str:
    """Compile the most frequent words of ``docs``; the path of the file in the shared folder.

    Words of up to 64 characters count (longer ones are merged, not looked up), and all words of the same count are in
    or out: at most ``lexicon_size`` words reach the driver.
    """
    spark, tok = docs.sparkSession, Tokenizer(tokenizer)
    counted = materialize(word_counts(docs, tokenizer, text_col).where(F.length("word") <= 64), "word-counts")
    # the least count above which at most lexicon_size words lie; one row per count, all large counts together
    held, least = 0, _MANY + 1
    for r in counted.groupBy(F.least("n", F.lit(_MANY)).alias("n")).count().orderBy(F.desc("n")).toLocalIterator():
        held += r["count"]
        if held > lexicon_size:
            break
        least = r.n
    frequent = [r.word for r in counted.where(F.col("n") >= least).select("word").collect()] if least <= _MANY else []
    known = dict(zip(pieces := [*{p for w in frequent for p in tok.pieces_of(w)}], tok.merge_all(pieces)))
    block = compile_transducer((w.encode(), [x for p in tok.pieces_of(w) for x in np.frombuffer(known[p], "<u4").tolist()]) for w in frequent)
    path = f"{scratch_path(spark, 'lexicon')}-{uuid.uuid4().hex[:8]}.bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        for at in range(0, len(block), 1 << 20):
            out.write(block[at: at + (1 << 20)])
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path


class Encoder:
    """Texts to ids; remembers at most ``_HELD`` words between slices."""

    def __init__(self, tokenizer: str, transducer: Transducer):
        self.tok, self.lexicon = Tokenizer(tokenizer), transducer
        self.known: dict[str, bytes] = {}  # words
        self.merged: dict[str, bytes] = {}  # pieces

    def _learn(self, words: list[str]) -> None:
        """Put words into ``known``: from the lexicon, or merged piece by piece."""
        tok, known, merged = self.tok, self.known, self.merged
        unseen = []
        for word, number in zip(words, self.lexicon.numbers([w.encode() for w in words]).tolist()):
            if number >= 0:
                known[word] = self.lexicon.output(number)
            else:
                unseen.append(word)
        pieces = [tok.pieces_of(w) for w in unseen]
        new = [*{p for found in pieces for p in found if p not in merged}]
        merged.update(zip(new, tok.merge_all(new)))
        for word, found in zip(unseen, pieces):
            known[word] = merged[found[0]] if len(found) == 1 else b"".join([merged[p] for p in found])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        tok, known = self.tok, self.known
        for held in (known, self.merged):
            if len(held) > _HELD:
                held.clear()
        cut = []
        for text in texts:
            spans = tok.special.split(text or "")
            cut.append([x if at % 2 else tok.words(x) for at, x in enumerate(spans)])
        unseen: set[str] = set()
        for spans in cut:
            for words in spans[::2]:
                unseen.update(words)
        if unseen := [w for w in unseen if w not in known]:
            self._learn(unseen)
        return [b"".join(struct.pack("<I", tok.specials[x]) if at % 2 else b"".join(map(known.__getitem__, x)) for at, x in enumerate(spans)) for spans in cut]

    def decode(self, ids: bytes) -> str:
        return self.tok.decode(np.frombuffer(ids, "<u4").tolist())


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           lexicon_size: int = LEXICON, digests: bool = False) -> DataFrame:
    """Encode and decode every whole text of ``docs``, one row for each of its rows.

    (doc_id, n_tokens, ids, decoded), or with ``digests`` (doc_id, n_tokens,
    ids_sha256, decoded_sha256). ids is binary, little-endian unsigned 32-bit. A
    null text counts as empty: no ids, decoded ''. An empty table gives an empty
    result and an empty lexicon; columns other than the two named are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()  # a file of fixed size; tasks get its text with their code
    lexicon = build_lexicon(docs, tokenizer, text_col, lexicon_size).rpartition("/")[2]
    kind = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    kind += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.binary()), ("decoded", pa.string())]
    schema = pa.schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, Transducer.open(SparkFiles.get(lexicon)))
        for part in slices(batches):
            ids = encoder.encode(part.column(1).to_pylist())
            n = [len(x) // 4 for x in ids]
            if digests:
                yield emit(schema, part.column(0), n, [hashlib.sha256(x).hexdigest() for x in ids],
                           [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids])
            else:
                yield emit(schema, part.column(0), n, ids, [encoder.decode(x) for x in ids])

    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    return docs.select(col(id_col).cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, out)
