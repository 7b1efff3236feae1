"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts are encoded by a byte-level BPE, which gives every byte back, cut losslessly into pieces of at most ``capacity``
tokens, and the pieces of a window of about ``WINDOW`` tokens go, longest first,
each into the row with the least room that still holds it. Rows by their free
room are the leaves of a segment tree over the capacities, so the search takes
log2(capacity) steps however many rows are open.

A task packs window after window of its own input: tokens are never shuffled and
memory is bounded by the window. A row holds the ids, the cumulative lengths of
its segments, positions that start again at every segment, and where each
segment comes from. Rows are written as binary files under the shared folder, at
most ``ROWS`` a file, and read back from the committed manifest, one task a file.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices
from tessera.llm.warc import file_system
from tessera.session import materialize, scratch_path

CAPACITY = 2_048
WINDOW = 1 << 20
#: Rows of one file.
ROWS = 8_192
#: Longer runs of blanks are taken out before the pattern, whose matcher backtracks over them on its stack.
_RUN = 4_096
# Fixed value: the characters of \\s.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % _RUN)


class Room:
    """Open rows by free room: a segment tree whose nodes count the rows below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove a row with the least room of at least ``need``; (row, room), or None."""
        at, count = need + self.leaves, self.count
        while not count[at]:
            while at & 1:  # a right child: what is larger lies beyond its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            at += not count[at]
        room = at - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers: longest piece first (ties in order), each into the fullest row that holds it."""
    room, rows = Room(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[piece])
        row, left = found if found else (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(piece)
        if left > lengths[piece]:
            room.put(row, left - lengths[piece])
    return rows


def pack_window(docs: list[tuple[int | None, np.ndarray]], capacity: int, pad: int, kind: str) -> Iterator[dict]:
    """Packed rows of (id, token ids) documents."""
    pieces = [(doc_id, at, ids[at: at + capacity]) for doc_id, ids in docs for at in range(0, len(ids), capacity)]
    for row in best_fit([len(p[2]) for p in pieces], capacity):
        ids, positions, ends = np.full(capacity, pad, kind), np.zeros(capacity, "<u2" if capacity <= 1 << 16 else "<u4"), [0]
        for piece in row:
            part, at = pieces[piece][2], ends[-1]
            ids[at: at + len(part)] = part
            positions[at: at + len(part)] = np.arange(len(part))
            ends.append(at + len(part))
        yield {"n_tokens": ends[-1], "ids": ids.tobytes(), "positions": positions.tobytes(), "cu_seqlens": ends,
               "doc_ids": [pieces[p][0] for p in row], "offsets": [pieces[p][1] for p in row]}


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """A tokenizer from the text of its rank file; a worker builds it once."""
    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def token_ids(encode: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a whole text.

    The pattern ends a piece before every run of blanks and takes the run as one
    piece, but for its last blank where a word follows. So a long run, without
    that blank, is merged as a piece and the texts around it are encoded as usual.
    """
    out, at = [], 0
    for run in _BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encode.encode_ordinary(text[at: run.start()])
        out += encode._core_bpe.encode_single_piece(text[run.start(): end].encode())
        at = end
    return out + encode.encode_ordinary(text[at:])


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         window: int = WINDOW) -> DataFrame:
    """(part, row, n_tokens, ids, positions, cu_seqlens, doc_ids, offsets): the packed rows of all whole texts.

    ids and positions are little-endian matrices of ``capacity`` columns, ids of
    16 bits if the vocabulary allows, else 32; behind n_tokens they hold the
    padding (the first id that the vocabulary leaves free) and zeros. Segment k
    is ids[cu_seqlens[k]:cu_seqlens[k + 1]], the tokens of document doc_ids[k]
    from offsets[k] on. Null and empty texts have no tokens and no segment;
    repeated rows are packed each for itself; an empty table gives an empty
    result. Other columns are not read.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()  # a file of fixed size; tasks get it with their code
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
                        ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks, pattern)
        pad, number, part_no = encode.max_token_value + 1, 0, TaskContext.get().partitionId()
        kind = "<u2" if pad < 1 << 16 else "<u4"

        def packed(docs: list) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = [*pack_window(docs, capacity, pad, kind)]
            for at in range(0, len(rows), 256):
                some = rows[at: at + 256]
                yield emit(schema, [part_no] * len(some), [*range(number, number + len(some))], *([r[n] for r in some] for n in schema.names[2:]))
                number += len(some)

        held, tokens = [], 0
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = np.array(token_ids(encode, text or ""), kind)
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= window:
                    yield from packed(held)
                    held, tokens = [], 0
        if held:
            yield from packed(held)

    return docs.select(col(id_col).cast("long"), col(text_col).cast("string")).mapInArrow(
        run, "part int, row long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<long>")


_ENDS = ("ids", "pos", "cu", "seg")
_SEGMENT = "<?qq"


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Write the packed rows as binary files in a folder that all executors share; the manifest (stem, part, row, rows).

    ``stem``.ids and ``stem``.pos are the matrices row after row, ``stem``.cu the
    cumulative lengths of all rows as 32-bit integers, each row led by their
    number, ``stem``.seg the document (a byte that is 0 for a null id, the id) and
    the offset of each segment. A stem holds ``rows`` rows of one part from ``row``
    on. Only files in the manifest count: what a lost attempt leaves is not
    among them.
    """
    schema = pa.schema([("stem", pa.string()), ("part", pa.int32()), ("row", pa.int64()), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = None

        def closed() -> pa.RecordBatch:
            for file in files:
                file.close()
            return emit(schema, [stem], [first[0]], [first[1]], [rows])

        for batch in slices(batches):
            for part, row, _, *data, docs, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                if stem is None:
                    stem, first, rows = f"{folder}/{uuid.uuid4().hex}", (part, row), 0
                    system, path = file_system(stem)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    files = [system.open_output_stream(f"{path}.{end}") for end in _ENDS]
                segments = b"".join(struct.pack(_SEGMENT, d is not None, d or 0, at) for d, at in zip(docs, offsets))
                for file, x in zip(files, (data[0], data[1], np.array([len(data[2]), *data[2]], "<u4").tobytes(), segments)):
                    file.write(x)
                rows += 1
                if rows == ROWS:
                    yield closed()
                    stem = None
        if stem is not None:
            yield closed()

    return materialize(packed.mapInArrow(run, "stem string, part int, row long, rows long"), "matrices")


def read_matrices(manifest: DataFrame, schema: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed rows of the files in a manifest; a file is one task's, read from its beginning to its end."""
    kinds = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
                       ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])
    dealt = manifest.repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            stem, number, first, rows = (c[0].as_py() for c in part.columns)
            system, path = file_system(stem)
            ids, positions, ends, segments = (system.open_input_stream(f"{path}.{end}") for end in _ENDS)
            width = [system.get_file_info(f"{path}.{end}").size // rows for end in ("ids", "pos")]
            if width[0] % capacity or width[1] % capacity:
                raise ValueError(f"{stem}: rows are not of {capacity} columns")
            for at in range(0, rows, 256):
                found = []
                for row in range(at, min(at + 256, rows)):
                    n = int.from_bytes(ends.read(4), "little")
                    lengths = np.frombuffer(ends.read(4 * n), "<u4").tolist()
                    from_ = [struct.unpack(_SEGMENT, segments.read(struct.calcsize(_SEGMENT))) for _ in lengths[1:]]
                    found.append((number, first + row, lengths[-1], ids.read(width[0]), positions.read(width[1]), lengths,
                                  [d if known else None for known, d, _ in from_], [x for *_, x in from_]))
                yield emit(kinds, *zip(*found))

    return dealt.mapInArrow(run, schema)


def pack_to_files(docs: DataFrame, ranks_path: str, pattern: str, **how) -> DataFrame:
    """``pack`` with its rows written to matrices in the shared folder and read back from there."""
    packed = pack(docs, ranks_path, pattern, **how)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema.fields)
    folder = scratch_path(docs.sparkSession, "matrices")
    return read_matrices(write_matrices(packed, folder), schema, how.get("capacity", CAPACITY))
