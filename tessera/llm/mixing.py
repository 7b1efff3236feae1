"""Mixing sources to target weights by Pareto order sampling.

A source's ratio is target / size. Every document of it gets floor(ratio) whole
copies for certain. The rest of the source's target is filled by a fixed-size
unequal-probability sample: with f the fraction of the ratio, a document's
inclusion odds are odds(f) x its relative weight, and documents are ranked by

    odds(u) / odds(inclusion),    u a hash of the document and the seed,

and taken in that order until the source's words are used up; the document at
the border is taken if more than half of it fits. Relative weights fall slowly
with length, so that a few very long texts do not fill a source's share.

Everything is DataFrame expressions. Running sums never put a source into one
task: documents fall into ``BINS`` bins by rank, bins are summed first, only the
bin at the border is put in order, and that bin is a small part of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.longform import occurrences
from tessera.llm.common import WORD, col
from tessera.session import materialize, stage_input

#: Bins of one source by rank; the border bin alone is sorted.
BINS = 4_096
#: A document is taken at most this often.
MOST = 2
WEIGHTS = (3.0, 1.0, 2.0)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, mark, key): words of each whole text, its MD5, and an MD5 of the three that tell documents apart."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    out = docs.select(col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"),
                      F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("mark"))
    return out.withColumn("key", _key(F.col("doc_id"), F.col("mark"), F.col("source")))


def _key(doc_id: Column, mark: Column, source: Column) -> Column:
    return F.md5(F.to_json(F.struct(doc_id.alias("d"), mark.alias("m"), source.alias("s"))))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """(source, source_size, target): one row per source; their running sums are
    one task's, so sources may be some millions, not documents.

    The sources in order of code point, null last, take the weights in turn and
    share ``share`` times all words. A target stops at MOST times its source's
    size; what is over is shared out again by weight. Equivalently target =
    least(MOST x size, level x weight) for one common level, which follows from
    two running sums over the sources in order of size / weight: no rounds.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1)
    by = by.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0.0)
    by = by.withColumn("total", share * F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    by = by.withColumn("full", F.coalesce(F.sum("cap").over(upto), zero)).withColumn("gone", F.coalesce(F.sum("weight").over(upto), zero))
    # the level if this source and all after it were below their caps
    level = (F.col("total") - F.col("full")) / (F.col("weights") - F.col("gone"))
    by = by.withColumn("level", level)
    open_from = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("gone"), F.col("level")))).over(every)
    shared = F.col("weight") * open_from["level"]
    return by.select("source", "source_size", F.coalesce(F.least("cap", shared), F.col("cap")).alias("target"))


def tempered(size: Column) -> Column:
    """Relative weight of a document in its source: falls with the fourth root of its length."""
    return F.pow(F.greatest(size, F.lit(1)).cast("double"), F.lit(-0.25))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, copies, taken) of every row of ``docs``.

    copies is 0 to MOST whole copies and taken = copies x size. Null texts and
    texts without words have size 0 and no copies; a null source is a source of
    its own, the last. Rows that repeat a document are sampled each for itself.
    An empty table gives an empty result; other columns are not read. The same
    rows give the same mix.
    """
    same = ["doc_id", "source", "size", "mark", "key"]
    counted = materialize(sizes(docs, id_col, text_col, source_col).groupBy(*same).agg(F.count("*").alias("rows")), "sizes")
    share_of = materialize(targets(counted.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share), "targets")
    # a row for every copy, each with its number: equal rows are drawn independently
    several = occurrences(counted.where("rows > 1"), same, "rows").withColumnRenamed("_occ", "occ")
    sized = counted.where("rows = 1").select(*same, F.lit(0).cast("long").alias("occ")).unionByName(several)
    other = share_of.withColumnRenamed("source", "of")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    marked = sized.join(other, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("ratio", ratio)
    marked = marked.withColumn("whole", F.when(F.col("size") > 0, F.floor("ratio")).otherwise(F.lit(0)).cast("long"))
    f = F.col("ratio") - F.floor("ratio")
    # 52 bits of a hash as a number within (0, 1)
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mark"), F.col("occ").cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    rank = (u / (1 - u)) / (f / (1 - f) * tempered(F.col("size")))
    marked = marked.withColumn("rank", F.when((f > 0) & (F.col("size") > 0), rank))
    # r / (1 + r) spreads the ranks over the bins; those near the border, where r is near 1, over most of them
    spread = F.floor(F.col("rank") / (1 + F.col("rank")) * BINS)
    marked = materialize(marked.withColumn("bin", F.least(spread, F.lit(BINS - 1)).cast("int")), "ranked")

    bins = marked.where("bin IS NOT NULL").groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("whole").alias("whole"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        F.col("source").alias("bin_source"), F.col("bin").alias("bin_no"), "words", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"))
    bins = materialize(bins, "bins")  # at most BINS rows a source

    # whole bins before the border are taken, the border bin is put in order
    border = bins.where("before < left AND before + words > left")
    inside = marked.join(border, marked.source.eqNullSafe(F.col("bin_source")) & (marked.bin == F.col("bin_no")))
    order = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "mark", "occ").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    one = so_far + F.col("size") / 2 <= F.col("left")
    kept = ["doc_id", "source", "size", "key", "source_size", "target"]
    inside = inside.withColumn("one", one.cast("long")).select(*kept, (F.col("whole") + F.col("one")).alias("copies"))

    edge = border.select("bin_source", "bin_no")
    full = bins.where("before + words <= left").groupBy("bin_source").agg(F.max("bin_no").alias("full_to"))
    rest = marked.join(edge, marked.source.eqNullSafe(edge.bin_source) & (marked.bin == edge.bin_no), "left_anti")
    rest = rest.join(full, rest.source.eqNullSafe(full.bin_source), "left")
    extra = F.coalesce((F.col("bin") <= F.col("full_to")).cast("long"), F.lit(0))
    rest = rest.select(*kept, (F.col("whole") + extra).alias("copies"))
    return rest.unionByName(inside).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows that the mix takes, with all columns of ``docs``, each as often as its copies.

    Rows equal in id, text and source share the copies of all of them out in turn.
    They are numbered by chunks of 2^16 rows of the input, so a row that makes up
    a third of the table is many tasks.
    """
    docs = stage_input(docs, "to-mix")  # read twice: its rows must be numbered alike
    taken = mix(docs, id_col, text_col, source_col, **how).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    mark = F.md5(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary"))
    key = _key(col(id_col).cast("long"), mark, col(source_col).cast("string"))
    ids = docs.select(key.alias("key"), F.monotonically_increasing_id().alias("row")).withColumn("chunk", F.shiftright("row", 16))
    ids = materialize(ids, "mixed-rows")
    chunks = ids.groupBy("key", "chunk").agg(F.count("*").alias("n")).join(taken, "key")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select(F.col("key").alias("of"), F.col("chunk").alias("part"), F.floor(F.col("copies") / F.col("rows")).alias("each"),
                           (F.col("copies") % F.col("rows") - before).alias("more"))
    place = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("row"))
    share = ids.join(chunks, (F.col("key") == F.col("of")) & (F.col("chunk") == F.col("part"))).withColumn("share", F.col("each") + (place <= F.col("more")).cast("long"))
    share = materialize(share.where("share > 0").select(F.col("row").alias("of"), "share"), "mixed-shares")
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")).join(share, F.col("row") == F.col("of"))
    copies = rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"))))
    return copies.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


#: The operator with default parameters in DuckDB's SQL: sizes, targets by the common level, ranks and running sums without bins.
SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS mark,
    row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS occ FROM documents),
source_sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + place % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM source_sizes),
levels AS (
  SELECT a.source, a.source_size, a.weight, a.cap,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM weighted) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight OR b.cap / b.weight = a.cap / a.weight AND b.place < a.place), 0))
    / sum(b.weight) FILTER (b.cap / b.weight > a.cap / a.weight OR b.cap / b.weight = a.cap / a.weight AND b.place >= a.place) AS level
  FROM weighted a, weighted b GROUP BY a.source, a.source_size, a.weight, a.cap, a.place),
common AS (SELECT max(level) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM common)), cap) AS target FROM levels),
ratios AS (
  SELECT s.doc_id, s.source, s.size, s.mark, s.occ, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
    (('0x' || substr(md5('42:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.mark || ':' || s.occ), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS f FROM ratios),
ordered AS (
  SELECT *, f > 0 AND size > 0 AS drawn,
    coalesce(sum(size) FILTER (f > 0 AND size > 0) OVER (PARTITION BY source ORDER BY
      CASE WHEN f > 0 AND size > 0 THEN (u / (1 - u)) / (f / (1 - f) * pow(greatest(size, 1)::DOUBLE, -0.25)) END NULLS LAST, doc_id, mark, occ
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM ranked),
copied AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN drawn AND so_far + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END END AS copies FROM ordered)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM copied
"""
