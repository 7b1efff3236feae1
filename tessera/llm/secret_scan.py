"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text: values assigned to a credential word,
access keys, long hex runs, and bare tokens that look random. The hash of each
value is aggregated over the corpus by distinct repositories and owners. A value
that many owners or many repositories hold is a copied example; one that a single
owner holds in few repositories and that looks random is a live-looking credential
of that owner; the rest is shared. A bare token becomes a finding if its value stands in a credential's
place somewhere in the corpus, or if it is live-looking itself.

Partial counts are one row per value, owner and repository, then one per value and owner, before any value's rows meet, and
findings go back to their texts by a join that Spark can split.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices, utf8
from tessera.session import materialize

# The patterns and least lengths of the kinds.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
#: From so many owners on a value is an example.
EXAMPLE_OWNERS = 3
#: From so many distinct repositories on a value is an example, even with one owner.
EXAMPLE_REPOSITORIES = 10
#: Bits a character from which a value looks random.
ENTROPY = 3.0


def entropy(value: bytes) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: bytes) -> bool:
    """Random rather than written: long, varied, letters and digits taking turns."""
    kinds = [65 <= (c & 0xDF) <= 90 for c in value if 48 <= c <= 57 or 65 <= (c & 0xDF) <= 90]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return len(value) >= 16 and turns >= 4 and entropy(value) >= ENTROPY


def looks_random(token: bytes) -> bool:
    """A bare token, without a word before it, needs both cases and digits."""
    return any(65 <= c <= 90 for c in token) and any(97 <= c <= 122 for c in token) and looks_live(token) and entropy(token) >= 3.5


def find(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) in bytes, by start and kind; a kind is its place in KINDS."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    for a, b in tokens:  # a long hex run lies within a long token
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, a, b)]
    base = sorted(out)
    for a, b in tokens:
        if not any(start < b and a < end for start, _, end, _ in base) and looks_random(text[a:b]):
            out.append((a, 3, b, text[a:b]))
    return sorted(out)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """One row per text: its base counts and digest, and its candidates as an array."""
    item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                      ("live", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("mark", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column(3).to_pylist():
                text = text or b""
                found, items, byte, point = find(text), [], 0, 0
                points = {}
                for at in sorted({x for f in found for x in (f[0], f[2])}):  # offsets in code points
                    point += at - byte if text.isascii() else len(text[byte:at].decode("utf-8", "replace"))
                    byte = at
                    points[at] = point
                for start, kind, end, value in found:
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(value), "<i8").tolist()
                    items.append({"start": points[start], "kind": kind, "end": points[end], "a": a, "b": b,
                                  "live": looks_live(value)})
                base = ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in items if x["kind"] < 3)
                n = Counter(x["kind"] for x in items)
                rows.append((n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), items))
            yield emit(schema, *part.columns[:3], *zip(*rows))

    mark = F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))
    return docs.select(col(id_col).cast("long"), F.coalesce(col(owner_col).cast("string"), F.lit("")), mark, utf8(text_col)).mapInArrow(
        run, "doc_id long, owner string, mark long, n_assign long, n_access long, n_hex long, base_sha256 string, "
             "found array<struct<start:long,kind:int,end:long,a:long,b:long,live:boolean>>")


def ownership(found: DataFrame) -> DataFrame:
    """(a, b, repositories, owners, keyed): per value hash the distinct texts (doc_id, mark) of each owner and the owners
    that hold it, and whether it ever stands in a credential's place."""
    by_text = found.groupBy("a", "b", "owner", "doc_id", "mark").agg(F.max(F.col("kind") < 2).alias("keyed"))
    by_owner = by_text.groupBy("a", "b", "owner").agg(F.count("*").alias("texts"), F.max("keyed").alias("keyed"))
    return by_owner.groupBy("a", "b").agg(F.sum("texts").alias("repositories"), F.count("*").alias("owners"), F.max("keyed").alias("keyed"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
             example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found) of every row of ``docs``.

    Each text is a repository of its own, ``owner_col`` its owner; a null owner
    counts as one owner without a name, and repeated rows as one text. found holds kind, span (code points, end
    exclusive), repositories, owners and verdict (live, example or shared), or is
    null without any.
    Null and empty texts have no findings. Repeated rows get equal answers, an
    empty table gives an empty result; other columns are not read.
    """
    scanned = materialize(scan(docs, id_col, text_col, owner_col), "candidates")
    each = scanned.select("doc_id", "owner", "mark", F.explode("found").alias("x")).select("doc_id", "owner", "mark", "x.*")
    held = ownership(each)
    verdict = (F.when((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories), F.lit("example"))
               .when(F.col("live") & (F.col("owners") == 1), F.lit("live")).otherwise(F.lit("shared")))
    judged = each.join(held, ["a", "b"]).withColumn("verdict", verdict).where((F.col("kind") < 3) | F.col("keyed") | (F.col("verdict") == "live"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    by_text = judged.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct(
        "start", "kind", "end", "repositories", "owners", "verdict", name.alias("name")))).alias("all"))
    by_text = by_text.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "all")
    out = scanned.drop("found").join(by_text, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    spans = F.concat_ws(",", F.transform("all", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))))
    having = lambda v: F.coalesce(F.size(F.filter("all", lambda x: x["verdict"] == v)), F.lit(0)).cast("long")
    found = F.transform("all", lambda x: F.struct(x["name"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                                  x["repositories"].alias("repositories"), x["owners"].alias("owners"), x["verdict"].alias("verdict")))
    none = F.col("all").isNull()
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"),
                      F.when(none, F.lit(0)).otherwise(having("live")).alias("n_live"), F.when(none, F.lit(0)).otherwise(having("example")).alias("n_example"),
                      found.alias("found"))
