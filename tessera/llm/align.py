"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

1. A task takes texts in blocks of about ``BLOCK`` characters. A single blank between
   two other characters begins a token of both tokenizers, so texts are cut there
   first, and each distinct stretch of a block is encoded and aligned once.
2. Per stretch the interval of all its tokens is cut at a common end near its
   middle: the A end nearest to the middle that a bisection finds among the B
   ends. Both halves are cut again; an interval without a common end inside is a
   leaf group. Intervals of one depth, of all stretches, are searched side by
   side. A text is its stretches in order, and has no tokens if one of them is
   not given back by both tokenizers.
3. A link is an A and a B token whose bytes overlap. Between two neighbouring
   ends of either kind lies exactly one of them. A block writes its distinct
   (A id, B id) pairs with their numbers, and the links of its stretches as numbers of
   those pairs.
4. Pairs are summed over all blocks, each B id's highest count is found, and both
   return to the blocks: a pair of a third of all links is one row a block.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_letters
from tessera.llm.common import col, emit, slices
from tessera.session import materialize

BLOCK = 8 << 20
#: Characters that are cut into stretches, and of stretches encoded, at a time.
_SLICE, _JOINED = 1 << 19, 1 << 15
#: Longer stretches are left to the JSON description's own library.
_LONG = 4_096
# Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NO = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


class Pair:
    """Tokenizers A (byte-level, a JSON description) and B (a sentence-piece model), and the bytes of their tokens."""

    def __init__(self, description: str, model: bytes):
        self.a = tokenizers.Tokenizer.from_str(description)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        shown = {letter: b for b, letter in enumerate(byte_letters())}
        vocab = self.a.get_vocab()
        added = {x["content"] for x in json.loads(description)["added_tokens"]}
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(shown[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.digits_a, self.digits_b = _texts_of_ids(len(self.bytes_a), b",|"), _texts_of_ids(len(self.bytes_b), b",;")
        # a piece of B never crosses a blank's beginning, and the pattern of A is the usual one: texts may be cut there
        pattern = json.dumps(json.loads(description).get("pre_tokenizer") or {})
        self.cuts = '"ByteLevel"' in pattern and '"Split"' not in pattern and not any(
            re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))

        # the same merges as ranks: bytes first, then what each merge makes, if no two make the same
        merges = json.loads(description)["model"]["merges"]
        made = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        tokens = [*shown, *(x + y for x, y in made)]
        ranks = {bytes(shown[c] for c in t): i for i, t in enumerate(tokens)} if self.cuts else {}
        self.id_of = [vocab[t] for t in tokens]
        self.fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(tokens) else None

    def stretches(self, text: str) -> list[str]:
        """The text between the blanks that begin tokens; every stretch has a blank before it, the first one too."""
        return _CUT.split(text) if self.cuts else [text]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def together(self, stretches: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of stretches that are cut from one another by single blanks, and how many each stretch has; none for
        one that is not given back."""
        ends = np.cumsum([1 + len(x.encode()) for x in stretches], dtype=np.int64)
        for a, b in self.encode([" ".join(stretches)], plain) if stretches else ():
            if a:
                a, b = np.array(a, np.int32), np.array(b, np.int32)
                counts = [np.diff(np.searchsorted(np.cumsum(length[ids]), ends), prepend=-1) for ids, length in ((a, self.length_a), (b, self.length_b))]
                return a, b, *counts
        if len(stretches) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), *(np.zeros(len(stretches), np.int64) for _ in "ab")
        half = len(stretches) // 2  # one of them is not: look for it
        return tuple(np.concatenate(x) for x in zip(self.together(stretches[:half], plain), self.together(stretches[half:], plain)))

    def encode(self, texts: list[str], plain: bool = False) -> Iterator[tuple[list[int], list[int]]]:
        """The A and B ids of each text, none if either does not give back its bytes. ``plain``: printable ASCII and line
        breaks without long runs of blanks, which the faster matcher cuts the same."""
        if plain and self.fast:
            found_a = [[self.id_of[r] for r in self.fast.encode_ordinary(" " + t)] for t in texts]
        else:
            found_a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        for text, a, b in zip(texts, found_a, self.b.encode(texts, num_threads=1)):
            raw = b" " + text.encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
            yield (a, b) if same else ([], [])


@lru_cache(maxsize=2)
def pair_of(description: str, model: bytes) -> Pair:
    return Pair(description, model)


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """The leaf groups (a_from, a_to, b_from, b_to) of intervals whose last A and B tokens end together, in order.

    ``ends_a`` and ``ends_b`` ascend over all intervals. All open intervals are cut side by side.
    """
    work, leaves = np.stack([a_from, a_to, b_from, b_to]).astype(np.int64), []
    while work.shape[1]:
        one = (work[1] - work[0] == 1) | (work[3] - work[2] == 1)
        leaves.append(work[:, one])
        work = work[:, ~one]
        cut = _nearest_cut(ends_a, ends_b, work[0], work[1])
        leaves.append(work[:, cut < 0])
        work, cut = work[:, cut >= 0], cut[cut >= 0]
        at = np.searchsorted(ends_b, ends_a[cut])
        work = np.concatenate([np.stack([work[0], cut + 1, work[2], at + 1]), np.stack([cut + 1, work[1], at + 1, work[3]])], axis=1)
    out = np.concatenate(leaves, axis=1) if leaves else np.zeros((4, 0), np.int64)
    return out[:, np.argsort(out[0], kind="stable")]


def _nearest_cut(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each interval the A token nearest to its middle, its last one apart, whose end is an end of B; -1 if there is none.

    Tokens are tried in rings around the middle, each ring twice as wide as the last.
    """
    out, middle = np.full(len(first), -1), (first + to - 2) // 2
    open_, inner, width = np.arange(len(first)), 0, 1
    while len(open_):
        # offsets inner .. inner + width - 1 to the right, the same to the left
        offset = np.arange(inner, inner + width)
        step = np.concatenate([offset, -offset[offset > 0]])
        step = step[np.lexsort([step, np.abs(step)])]
        for at in range(0, len(open_), rows := max(1, (1 << 20) // len(step))):
            some = open_[at: at + rows]
            token = middle[some][:, None] + step
            inside = (token >= first[some][:, None]) & (token < to[some][:, None] - 1)
            row, place = np.nonzero(inside)
            token = token[row, place]
            end = ends_a[token]
            hit = ends_b[np.minimum(np.searchsorted(ends_b, end), len(ends_b) - 1)] == end
            row, token = row[hit], token[hit]
            found, nearest = np.unique(row, return_index=True)  # steps ascend by distance
            out[some[found]] = token[nearest]
        inner, width = inner + width, 2 * width
        open_ = open_[(out[open_] < 0) & ((middle[open_] + inner < to[open_] - 1) | (middle[open_] - inner >= first[open_]))]
    return out


def _texts_of_ids(size: int, signs: bytes) -> np.ndarray:
    """[sign * size + id] -> decimal id and the sign, padded with NUL."""
    return np.array([str(i).encode() + bytes([s]) for s in signs for i in range(size)], "S8")


class Block:
    """Some texts, and their distinct stretches aligned."""

    def __init__(self, pair: Pair):
        self.pair, self.size = pair, 0
        self.ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.known: dict[str, int] = {}

    def add(self, ids: list[int | None], texts: list[str]) -> None:
        self.ids += ids
        known = self.known
        for text in texts:
            found = self.pair.stretches(text) if text else []
            for x in found:
                if x not in known:
                    known[x] = len(known)
            self.texts.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
            self.size += len(text)

    def _encoded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all distinct stretches, ``n_a`` and ``n_b`` of each, and where a stretch stands in that order."""
        pair, kinds = self.pair, ([], [], [])
        for at, x in enumerate(self.known):
            alone = not pair.cuts or x != x.strip()  # blanks at an end: its cuts are not those of its neighbours
            plain = len(x) < _LONG and x.isascii() and (x.isprintable() or x.replace("\n", "").isprintable())
            kinds[0 if alone else 1 + plain].append((at, x))
        found = [pair.together([x]) for _, x in kinds[0]]
        for kind in (1, 2):
            waiting, size = [], 0
            for _, x in kinds[kind]:
                waiting.append(x)
                size += len(x)
                if size >= _JOINED:
                    found.append(pair.together(waiting, kind == 2))
                    waiting, size = [], 0
            found.append(pair.together(waiting, kind == 2))
        place = np.empty(len(self.known), np.uint32)
        place[[at for kind in kinds for at, _ in kind]] = np.arange(len(place))
        a, b, self.n_a, self.n_b = (np.concatenate(x) for x in zip(*found))
        return a, b, place

    def close(self) -> tuple[list, tuple[bytes, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Columns (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, stretches) of the texts, the links of the stretches with
        how many each has, and the pairs: places among the distinct ones, ids, links."""
        pair, (a, b, place) = self.pair, self._encoded()
        self.texts = [place[x] for x in self.texts]
        n_a, n_b = self.n_a, self.n_b
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
        full = np.flatnonzero(n_a)
        groups = shared_groups(ends_a, ends_b, (to_a - n_a)[full], to_a[full], (to_b - n_b)[full], to_b[full])
        n_groups = np.diff(np.searchsorted(groups[1], to_a, side="right"), prepend=0)

        # tokens in the order in which the groups name them, each with the sign behind it
        sign_a, sign_b = np.zeros(len(a), np.int32), np.zeros(len(b), np.int32)
        sign_a[groups[1] - 1], sign_b[groups[3] - 1] = len(pair.bytes_a), len(pair.bytes_b)
        named = np.empty(len(a) + len(b), "S8")
        named[np.arange(len(a)) + np.repeat(groups[2], groups[1] - groups[0])] = pair.digits_a[a + sign_a]
        named[np.arange(len(b)) + np.repeat(groups[1], groups[3] - groups[2])] = pair.digits_b[b + sign_b]
        to = to_a + to_b
        names = [named[x:y].tobytes().replace(b"\0", b"")[:-1] for x, y in zip((to - n_a - n_b).tolist(), to.tolist())]
        del named, groups

        ends = np.union1d(ends_a, ends_b)
        linked = a[np.searchsorted(ends_a, ends)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, ends)]
        pairs, links = np.unique(linked, return_inverse=True)
        n_links = n_a + n_b - n_groups

        sizes = np.array([len(x) for x in self.texts], np.int64)
        every, of = np.concatenate(self.texts), np.repeat(np.arange(len(sizes)), sizes)
        whole = np.bincount(of, n_a[every] == 0, len(sizes)) == 0  # every stretch is given back
        times = np.bincount(every[whole[of]], minlength=len(n_a))
        count = np.bincount(links, np.repeat(times, n_links), len(pairs)).astype(np.int64)
        sums = [np.where(whole, np.bincount(of, x[every], len(sizes)), 0).astype(np.int64) for x in (n_a, n_b, n_groups, n_links)]
        shas, kept = [], []
        for x, ok in zip(self.texts, whole & (sizes > 0)):
            shas.append(hashlib.sha256(b";".join(map(names.__getitem__, x.tolist()))).hexdigest() if ok else "")
            kept.append(x.tobytes() if ok else b"")
        at = np.flatnonzero(count)
        return [self.ids, *sums, shas, kept], (links.astype("<u4").tobytes(), n_links.astype("<u4").tobytes()), (at.astype(np.int32), pairs[at], count[at])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of ``docs``.

    Texts that are null, empty or not given back byte for byte by both tokenizers
    have no tokens: zeros and ''. Rows that repeat an id or a text are aligned
    and counted each for itself; a null id is kept. An empty table gives an empty
    result; columns other than the two named are not read. A task holds about
    ``block`` bytes of text, or one longer text.
    """
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = f.read(), g.read()  # files of fixed size; tasks get them with their code
    schema = pa.schema([("block", pa.int64()), *((x.split()[0], pa.int64()) for x in _NO.split(", ")), ("groups_sha256", pa.string()), ("stretches", pa.binary()),
                        ("links", pa.binary()), ("sizes", pa.binary()), ("at", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = pair_of(*files), TaskContext.get().partitionId() << 32
        none = lambda n, *which: (pa.nulls(n, schema.types[i]) for i in range(*which))

        def closed(open_: Block) -> Iterator[pa.RecordBatch]:
            texts, (links, sizes), (at, pairs, n) = open_.close()
            for x in range(0, len(open_.ids), 512):
                some = [c[x: x + 512] for c in texts]
                yield emit(schema, [number] * len(some[0]), *some, *none(len(some[0]), 8, 13))
            yield emit(schema, [number], *none(1, 1, 8), [links], [sizes], *none(1, 10, 13))
            for x in range(0, len(pairs), 1 << 15):
                k = len(at[x: x + (1 << 15)])
                yield emit(schema, np.full(k, number), *none(k, 1, 10), at[x: x + k], pairs[x: x + k], n[x: x + k])

        open_ = Block(pair)
        for part in slices(batches):
            ids, texts, at = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()], 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and size < _SLICE:
                    size += len(texts[to])
                    to += 1
                open_.add(ids[at:to], texts[at:to])
                at = to
                if open_.size >= block:
                    yield from closed(open_)
                    open_, number = Block(pair), number + 1
        if open_.ids:
            yield from closed(open_)

    kept = materialize(docs.select(col(id_col).cast("long"), col(text_col).cast("string")).mapInArrow(
        run, f"block long, {_NO}, groups_sha256 string, stretches binary, links binary, sizes binary, at int, pair long, n long"), "alignment")
    texts, pairs = kept.where("pair IS NULL").drop("at", "pair", "n"), kept.where("pair IS NOT NULL").select("block", "at", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    highest = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    found = pairs.join(known, "pair").select(F.col("block").alias("home"), "at", "count", "best")
    out = pa.schema([*((x.split()[0], pa.int64()) for x in _NO.split(", ")), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def total(texts: pa.Table, found: pa.Table) -> pa.Table:
        at = found.column("at").to_numpy()
        count, best = (np.zeros(1 + (at.max() if len(at) else 0), np.int64) for _ in range(2))
        count[at], best[at] = found.column("count").to_numpy(), found.column("best").to_numpy()
        block = texts.filter(pa.compute.is_valid(texts.column("links")))
        texts = texts.filter(pa.compute.is_valid(texts.column("stretches")))
        links, to = np.frombuffer(block.column("links")[0].as_py(), "<u4"), np.cumsum(np.frombuffer(block.column("sizes")[0].as_py(), "<u4").astype(np.int64))
        # what each stretch adds, by differences of running sums
        added = [np.diff(np.concatenate([[0], np.cumsum(t[links])])[np.concatenate([[0], to])]) for t in (best, count)]
        found = [np.frombuffer(x.as_py(), np.uint32) for x in texts.column("stretches")]
        both = [[int(t[x].sum()) for x in found] for t in added]
        return pa.table([*(texts.column(x) for x in out.names[:5]), *both, texts.column("groups_sha256")], schema=out)

    return texts.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(total, f"{_NO}, n_best long, count_sum long, groups_sha256 string")
