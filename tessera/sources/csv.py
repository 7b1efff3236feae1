"""CSV sources and sinks.

Large inputs need no chunking: Spark splits files by
``spark.sql.files.maxPartitionBytes``. Encoding and delimiter sniffing run as
Spark aggregates over the text lines of every file (grouped by
``_metadata.file_path``), so a directory of many large files is sniffed in
one distributed pass instead of opening each file on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import is_folder, materialize, path_exists

# --- Fixed values: supported extensions, candidate delimiters ---------------
CSV_EXTENSIONS = (".csv", ".tsv", ".txt")
DELIMITERS = [",", "\t", ";", "|"]
DEFAULT_DELIMITER = ","
# --- end of fixed values ---------------------------------------------------

_BOM = "\ufeff"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("file_path"),
                    F.col("_metadata.file_size").alias("file_size"), "value"))


def csv_sniff(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, encoding, delimiter, size_bytes, lines, avg_line_len) of every file in one scan.

    The encoding is 'utf-8' when every line is valid UTF-8, else 'latin-1' (which
    decodes any byte string). The delimiter is, among the candidates that occur in
    lines that are not empty, the one whose count per line varies least, then the
    most frequent; ',' when none does. What is quoted delimits nothing."""
    bare = F.regexp_replace("value", r'"[^"]*"', "")
    found = [F.when(F.length("value") > 0, F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))) for d in DELIMITERS]
    per = _lines(spark, path).select("file_path", "file_size", F.is_valid_utf8("value").cast("int").alias("ok"), (F.octet_length("value") + 1).alias("bytes"),
                                     *[n.alias(f"n{i}") for i, n in enumerate(found)])
    per = per.groupBy("file_path").agg(
        F.first("file_size").cast("long").alias("size_bytes"), F.count(F.lit(1)).cast("long").alias("lines"), F.avg("bytes").alias("avg_line_len"), F.min("ok").alias("ok"),
        *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(DELIMITERS))], *[F.var_pop(f"n{i}").alias(f"v{i}") for i in range(len(DELIMITERS))])
    seen = F.array(*[F.when(F.col(f"t{i}") > 0, F.struct(F.col(f"v{i}").alias("var"), (-F.col(f"t{i}")).alias("nt"), F.lit(i).alias("d"))) for i in range(len(DELIMITERS))])
    names = F.element_at(F.array(*[F.lit(d) for d in DELIMITERS]), F.array_min(seen).getField("d") + 1)
    return per.select("file_path", F.when(F.col("ok") == 1, "utf-8").otherwise("latin-1").alias("encoding"),
                      F.coalesce(names, F.lit(DEFAULT_DELIMITER)).alias("delimiter"), "size_bytes", "lines", "avg_line_len")


def csv_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, encoding) as ``csv_sniff`` finds it."""
    return csv_sniff(spark, path).select("file_path", "encoding")


def csv_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, delimiter) as ``csv_sniff`` finds it."""
    return csv_sniff(spark, path).select("file_path", "delimiter")


def clean_header(names: list[str]) -> list[str]:
    return [n.replace(_BOM, "").strip() for n in names]


def _read_alike(spark: SparkSession, paths: str | list[str], sep: str, encoding: str, infer_schema: bool) -> DataFrame:
    df = (spark.read.option("header", True).option("inferSchema", infer_schema).option("sep", sep)
          .option("encoding", encoding).option("recursiveFileLookup", "true").csv(paths))
    if not df.columns:
        raise ValueError(f"empty CSV input: {paths}")
    return df.toDF(*clean_header(df.columns))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
             infer_schema: bool = True) -> DataFrame:
    """CSV/TSV with a header row; header names trimmed and BOM-stripped.

    Delimiter and encoding are sniffed per file (one distributed scan) when not
    given; files that share both are read together and the groups are united by
    column name (a column that a group lacks is NULL there; types that differ
    between groups become text). Raises FileNotFoundError / ValueError for a
    missing path, an unsupported extension or an empty input."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    if not is_folder(spark, path) and not path.lower().endswith(CSV_EXTENSIONS):
        raise ValueError(f"unsupported file type: {path}")
    if sep is not None and encoding is not None:
        return _read_alike(spark, path, sep, encoding, infer_schema)
    sniffed = materialize(csv_sniff(spark, path).select(
        "file_path", F.lit(sep).alias("delimiter") if sep else "delimiter", F.lit(encoding).alias("encoding") if encoding else "encoding"), "sniffed")
    kinds = sniffed.select("delimiter", "encoding").distinct().orderBy("delimiter", "encoding").collect()
    if not kinds:
        raise ValueError(f"empty CSV input: {path}")
    enc = lambda e: {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}.get(e, e)
    if len(kinds) == 1:  # the folder itself: no list of files
        return _read_alike(spark, path, kinds[0]["delimiter"], enc(kinds[0]["encoding"]), infer_schema)
    parts = []
    for k in kinds:  # a reader takes its files by name, as it lists those of a folder
        files = sniffed.where((F.col("delimiter") == k["delimiter"]) & (F.col("encoding") == k["encoding"])).select("file_path").orderBy("file_path")
        parts.append(_read_alike(spark, [r["file_path"] for r in files.toLocalIterator()], k["delimiter"], enc(k["encoding"]), infer_schema))
    types: dict[str, set] = {}
    for p in parts:
        for name, kind in p.dtypes:
            types.setdefault(name, set()).add(kind)
    mixed = {c for c, kinds_ in types.items() if len(kinds_) > 1}
    out = None
    for p in parts:
        p = p.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in p.columns])
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> str:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, records): the records of every file, the header among them, where quoted fields may span lines.

    A file need not be one task. Whether a line ends a record depends on the
    quotes before it, so each split counts for both cases: the records that end
    in it if it begins outside of quotes, and if it begins inside. Splits of a
    file, in order, are composed by the running sum of their quotes. Blank lines
    between records are none; a file that ends inside quotes ends its last
    record. Quotes inside quoted fields are doubled (RFC 4180)."""
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = (spark.read.option("recursiveFileLookup", "true").text(path)
             .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"),
                     quotes.cast("long").alias("quotes"), (F.length(F.trim("value")) == 0).alias("blank")))
    schema = pa.schema([("file_path", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}  # a row per split
        for batch in batches:
            if not batch.num_rows:
                continue
            n, blank = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            files = batch.column(0).dictionary_encode()
            where = np.stack([files.indices.to_numpy(), batch.column(1).to_numpy()])
            edges = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:]):
                state = held.setdefault((files.dictionary[int(where[0, x])].as_py(), int(where[1, x])), [0, 0, 0])
                after = (state[0] + np.cumsum(n[x:y])) % 2
                before = (after - n[x:y]) % 2
                state[1] += int(((after == 0) & ~(blank[x:y] & (before == 0))).sum())
                state[2] += int(((after == 1) & ~(blank[x:y] & (before == 1))).sum())
                state[0] += int(n[x:y].sum())
        rows = [(f, s, *v) for (f, s), v in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    splits = lines.mapInArrow(run, "file_path string, start long, quotes long, outside long, inside long")
    order = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    entered = splits.withColumn("before", F.coalesce(F.sum("quotes").over(order), F.lit(0)) % 2)
    ended = F.sum(F.when(F.col("before") == 0, F.col("outside")).otherwise(F.col("inside")))
    return entered.groupBy("file_path").agg((ended + F.sum("quotes") % 2).alias("records"))


def csv_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: size, encoding, delimiter, line count, average line
    length in bytes, the size-based row estimate (size / average line length
    − 1) and the exact number of records without the header (quoted fields may
    span lines and splits)."""
    out = csv_sniff(spark, path).join(csv_records(spark, path), "file_path", "left")
    return out.select("file_path", F.col("size_bytes").cast("long"), "encoding", "delimiter",
                      F.col("lines").cast("long"), F.round("avg_line_len", 2).alias("avg_line_len"),
                      F.floor(F.col("size_bytes") / F.col("avg_line_len") - 1).cast("long").alias("row_estimate"),
                      F.greatest(F.coalesce(F.col("records"), F.lit(0)) - 1, F.lit(0)).cast("long").alias("rows"))
