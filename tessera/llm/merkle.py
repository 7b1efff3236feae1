"""Merkle manifest of a table: one tree per source, a tree over their roots, and octopus multiproofs.

1. A row's leaf is a digest of its fields. Leaves are put in order by source,
   id and digest in range partitions; the runs' totals give each leaf's place in
   its source, so no source is in one task.
2. Sixteen consecutive nodes become their parent, level by level, until one node
   is left: a shuffle of a sixteenth of the last one's rows. The subroots, in
   order of source, are the leaves of a tree of their own.
3. Wanted leaves are dealt in spans of ``SPAN`` places. From the places alone a span
   knows which nodes its proofs need that its own leaves do not give: the missing
   siblings, level by level, of all that it will know by then. That smallest set
   is fetched by one join on node coordinates, so a node that all proofs of a
   span need comes once. The span then derives the nodes between and writes each
   leaf's own proof.
"""

from __future__ import annotations

import hashlib
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col
from tessera.session import materialize

WIDTH = 16
SPAN = WIDTH**3
#: The tree over the sources' roots; sources are trees 0, 1, ...
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """sha256 over all fields, each its length in bytes, a colon and its value, a null one a dash."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown)).cast("binary"), 256)


@dataclass
class Manifest:
    leaves: DataFrame  # tree, at (place in the tree), size (leaves of the tree), leaf and what the table carried
    nodes: DataFrame  # tree, level, at, digest of all nodes, the leaves too
    root: str | None  # None without leaves
    sources: int


def placed(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """``rows`` plus ``tree`` (the source's number, null first, then by UTF-8), ``at`` and ``size``."""
    spark = rows.sparkSession
    fixed = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")  # equal rows may part anywhere
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (source, *order, "tie")]
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = fixed.repartitionByRange(runs, *by).sortWithinPartitions(*by)
    dealt = materialize(dealt.drop("tie").withColumn("run", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "leaves")
    parts = dealt.groupBy(col(source).alias("of"), F.col("run").alias("part")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    of = Window.partitionBy("of")
    before = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.sum("n").over(of))
    # a source's number is how many sources begin before it: runs are in order, and within a run the first places are
    begins = parts.where("before = 0")
    within = Window.partitionBy("part").orderBy("first")
    begins = materialize(begins.withColumn("inside", F.row_number().over(within) - 1), "sources")
    starts = begins.groupBy("part").agg(F.count("*").alias("k"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    starts = starts.select(F.col("part").alias("p"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("offset"))
    numbered = begins.join(starts, F.col("part") == F.col("p")).select(F.col("of").alias("s"), (F.col("offset") + F.col("inside")).cast("long").alias("tree"))
    parts = materialize(parts.join(numbered, F.col("of").eqNullSafe(F.col("s"))).drop("s"), "places")
    # (run, source) parts a source that holds a third of the rows
    joined = dealt.join(parts, (F.col("run") == F.col("part")) & col(source).eqNullSafe(F.col("of")))
    return joined.select("tree", (F.col("before") + F.col("seq") - F.col("first")).alias("at"), "size", *(col(c) for c in rows.columns))


def grow(leaves: DataFrame, most: int) -> list[DataFrame]:
    """(tree, level, at, digest, size) of each level; trees with one node left go no further. ``most``: leaves of the largest tree."""
    levels, width = [leaves.select("tree", F.lit(0).alias("level"), "at", "digest", "size")], most
    while width > 1:
        run = F.array_sort(F.collect_list(F.struct("at", "digest")))
        up = levels[-1].where("size > 1").groupBy("tree", F.expr(f"at DIV {WIDTH}").alias("at"), F.expr(f"(size + {WIDTH - 1}) DIV {WIDTH}").alias("size")).agg(
            F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))
        levels.append(materialize(up.select("tree", F.lit(len(levels)).alias("level"), "at", "digest", "size"), "nodes"))
        width = -(-width // WIDTH)
    return levels


def build(rows: DataFrame, source: str = "source", order: list[str] | None = None) -> Manifest:
    """The trees over ``rows``, whose column ``leaf`` is a digest; within a source they ascend by ``order`` (null first), then by leaf."""
    leaves = materialize(placed(rows, source, [*(order or ["doc_id"]), "leaf"]), "leaves")
    most = leaves.agg(F.max("size").alias("m"), F.max("tree").alias("t")).first()
    if most.m is None:
        none = leaves.select("tree", F.lit(0).alias("level"), "at", F.col("leaf").alias("digest"))
        return Manifest(leaves, none, None, 0)
    levels = grow(leaves.withColumnRenamed("leaf", "digest"), most.m)
    roots = [x.where("size = 1").select(F.col("tree").alias("at"), "digest") for x in levels]
    first = roots[0]
    for other in roots[1:]:
        first = first.unionByName(other)
    subroots = materialize(first.select(F.lit(TOP).cast("long").alias("tree"), "at", "digest", F.lit(most.t + 1).cast("long").alias("size")), "subroots")
    top = grow(subroots, most.t + 1)
    nodes = None
    for x in (*levels, *top):
        x = x.select("tree", "level", "at", "digest")
        nodes = x if nodes is None else nodes.unionByName(x)
    return Manifest(leaves, nodes, top[-1].first().digest, most.t + 1)


def missing(places: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """The coordinates (level, places) that the leaves at ``places`` of a tree of ``size`` leaves need and do not give themselves."""
    out, level, known = [], 0, np.unique(places)
    while size > 1:
        runs = np.unique(known // WIDTH)
        run = (runs[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        out.append((level, np.setdiff1d(run[run < size], known, assume_unique=True)))
        known, size, level = runs, -(-size // WIDTH), level + 1
    return out


class Known:
    """The nodes of one tree that a span holds: its leaves, the fetched ones, and all that follow from them."""

    def __init__(self, size: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.runs: list[dict[int, list[str]]] = []  # level -> run -> its digests
        level, known = 0, dict(leaves)
        while size > 1:
            runs = {}
            for run in {at // WIDTH for at in known}:
                places = range(run * WIDTH, min((run + 1) * WIDTH, size))
                runs[run] = [known[at] if at in known else fetched[level, at] for at in places]
            self.runs.append(runs)
            known = {run: sha("".join(digests)) for run, digests in runs.items()}
            size, level = -(-size // WIDTH), level + 1
        (self.root,) = set(known.values()) if self.runs else set(leaves.values())

    def siblings(self, level: int, at: int) -> tuple[str, str]:
        run = self.runs[level][at // WIDTH]
        return "".join(run[: at % WIDTH]), "".join(run[at % WIDTH + 1:])


def prove(manifest: Manifest, shown: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of some or all rows of ``manifest.leaves``.

    ``shown`` holds such rows with a column ``shown``, the digest that is put to the
    test; folded_root is what it gives with the leaf's siblings.
    """
    spans = shown.withColumn("span", F.expr(f"at DIV {span}"))
    coordinates = "tree long, span long, of long, level int, at long"
    kind = pa.schema([("tree", pa.int64()), ("span", pa.int64()), ("of", pa.int64()), ("level", pa.int32()), ("at", pa.int64())])
    sources, root = manifest.sources, manifest.root

    def needs(key: tuple, rows: pa.Table) -> pa.Table:
        tree, no = (k.as_py() for k in key)
        wanted = [(tree, *x) for x in missing(rows.column("at").to_numpy(), rows.column("size")[0].as_py())]
        wanted += [(TOP, *x) for x in missing(np.array([tree]), sources)]
        of, level, at = ([x for x, _, places in wanted for _ in places], [x for _, x, places in wanted for _ in places],
                         np.concatenate([np.zeros(0, np.int64), *(places for _, _, places in wanted)]))
        return pa.table([[tree] * len(at), [no] * len(at), of, level, at], schema=kind)

    asked = spans.select("tree", "span", "at", "size").groupBy("tree", "span").applyInArrow(needs, coordinates)
    nodes = manifest.nodes.select(F.col("tree").alias("n_tree"), F.col("level").alias("n_level"), F.col("at").alias("n_at"), "digest")
    fetched = asked.join(nodes, (F.col("of") == F.col("n_tree")) & (F.col("level") == F.col("n_level")) & (F.col("at") == F.col("n_at")))
    fetched = fetched.select("tree", "span", "of", "level", "at", "digest")
    out = pa.schema([("doc_id", pa.int64()), *((x, pa.string()) for x in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def expand(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        size, tree = rows.column("size")[0].as_py(), rows.column("tree")[0].as_py()
        given: dict[bool, dict[tuple[int, int], str]] = {False: {}, True: {}}
        for of, level, at, digest in zip(*(fetched.column(x).to_pylist() for x in ("of", "level", "at", "digest"))):
            given[of == TOP][level, at] = digest
        places, leaves = rows.column("at").to_pylist(), rows.column("leaf").to_pylist()
        mine = Known(size, dict(zip(places, leaves)), given[False])
        above = Known(sources, {tree: mine.root}, given[True])
        path = {}  # run of leaves -> the siblings on its way to the root, from the level above the leaves on

        def way(run: int) -> list[tuple[str, str]]:
            if run not in path:
                steps, at = [], run
                for level in range(1, len(mine.runs)):
                    steps.append(mine.siblings(level, at))
                    at //= WIDTH
                at = tree
                for level in range(len(above.runs)):
                    steps.append(above.siblings(level, at))
                    at //= WIDTH
                path[run] = steps, "".join(a + b for a, b in steps)
            return path[run]

        columns = []
        for doc_id, at, leaf, test in zip(rows.column("doc_id").to_pylist(), places, leaves, rows.column("shown").to_pylist()):
            steps, rest = way(at // WIDTH)
            left, right = mine.siblings(0, at) if mine.runs else ("", "")
            folded = above.root
            if test != leaf:
                folded = sha(left + test + right) if mine.runs else test
                for a, b in steps:
                    folded = sha(a + folded + b)
            columns.append((doc_id, leaf, mine.root, root, sha(left + right + rest), folded, folded == root))
        return pa.table([list(c) for c in zip(*columns)], schema=out)

    return spans.groupBy("tree", "span").cogroup(fetched.groupBy("tree", "span")).applyInArrow(
        expand, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source_col: str = "source", **carried: Column) -> Manifest:
    """The manifest of ``docs``: a leaf over ``fields`` (the first is the id) for every row; ``carried`` columns stay with the leaves.

    Nulls are values of their own (ids and sources of null come first), rows that
    repeat are leaves of their own, an empty table has no root. Other columns are
    not read.
    """
    return build(docs.select(col(fields[0]).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"),
                             leaf_digest(*(col(f) for f in fields)).alias("leaf"), *(c.alias(x) for x, c in carried.items())))


def audit(docs: DataFrame, parts: int = 5) -> DataFrame:
    """Proofs of all rows of ``docs``, put to the test on texts whose A-Z are lower-cased where crc32 of the id is a multiple of ``parts``."""
    bent = F.translate(col("text"), string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(col("doc_id").cast("long").cast("string")) % parts == 0
    shown = F.when(tampered, leaf_digest(*(bent if f == "text" else col(f) for f in FIELDS))).otherwise(leaf_digest(*(col(f) for f in FIELDS)))
    found = manifest(docs, shown=shown)
    return prove(found, found.leaves)


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: ``audit`` in DuckDB's SQL: recursion over the levels; crc32 bit by bit.
SQL = f"""
WITH RECURSIVE digests AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
    {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS bent,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
      lambda i: list_concat([ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, leaf, CASE WHEN crc % 5 = 0 THEN bent ELSE leaf END AS shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM digests),
nodes AS (
  SELECT tree, 0 AS level, pos, size, leaf AS digest FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 16, size),
subroots AS (SELECT tree, digest FROM nodes WHERE size = 1),
top AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS size, digest FROM subroots
  UNION ALL SELECT level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE size > 1 GROUP BY level, pos // 16, size),
root AS (SELECT digest AS root FROM top WHERE size = 1),
siblings AS (
  SELECT tree, level, pos, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT tree, level, pos, size, digest FROM nodes UNION ALL SELECT -1, level, pos, size, digest FROM top) WHERE size > 1
  WINDOW run AS (PARTITION BY tree, level, pos // 16 ORDER BY pos)),
below AS (
  SELECT tree, pos AS leaf_pos, 0 AS level, pos, shown AS folded, '' AS proof FROM leaves
  UNION ALL SELECT b.tree, leaf_pos, b.level + 1, b.pos // 16, sha256(l || folded || r), proof || l || r FROM below b JOIN siblings s ON s.tree = b.tree AND s.level = b.level AND s.pos = b.pos),
above AS (
  SELECT tree, leaf_pos, 0 AS level, tree AS pos, folded, proof FROM (SELECT *, row_number() OVER (PARTITION BY tree, leaf_pos ORDER BY level DESC) AS last FROM below) WHERE last = 1
  UNION ALL SELECT a.tree, leaf_pos, a.level + 1, a.pos // 16, sha256(l || folded || r), proof || l || r FROM above a JOIN siblings s ON s.tree = -1 AND s.level = a.level AND s.pos = a.pos),
ends AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_pos ORDER BY level DESC) AS last FROM above)
SELECT x.doc_id, x.leaf, s.digest AS subroot, r.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.root AS verified
FROM leaves x JOIN ends e ON e.tree = x.tree AND e.leaf_pos = x.pos AND e.last = 1 JOIN subroots s ON s.tree = x.tree CROSS JOIN root r
"""
