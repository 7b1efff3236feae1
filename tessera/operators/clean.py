"""Cleaning pipeline.

Each step is a narrow projection except de-duplication (one full-row
shuffle). Where a step needs a data-dependent decision (a fill value, which
columns are empty, whether a whole column parses), it is taken from ONE
one-row aggregate for all columns at once; nothing else reaches the driver.

Fixed order (each step switchable): dedupe -> fill numeric -> fill text ->
parse dates -> strip whitespace -> drop empty columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import col
from tessera.functions.longform import modes
from tessera.functions.nulls import normalize_nulls
from tessera.functions.schema import DATE_PARSE_KEYWORDS, categorical_cols, numeric_cols
from tessera.session import materialize
from tessera.functions.colstats import quantile_row

# --- Fixed values: date formats tried in order, and the text-fill default ---
DEFAULT_DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy", "dd.MM.yyyy",
    "d MMM yyyy", "MMM d, yyyy",
]
UNKNOWN_FILL = "Unknown"
# --- end of fixed values ---------------------------------------------------

# Leading / trailing whitespace in the Unicode sense (tabs, newlines, NBSP).
_EDGE_WS = r"(?U)^\s+|\s+$"


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Coerce text to double; unparsable -> NULL."""
    s = set(cols)
    return df.select([col(c).try_cast(T.DoubleType()).alias(c) if c in s else col(c) for c in df.columns])


def parse_timestamp(c, formats: list[str] | None = None):
    fmts = formats or DEFAULT_DATE_FORMATS
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in fmts]).cast("timestamp_ntz")


def time_col(df: DataFrame, name: str):
    """A date argument: a text column is parsed (bad values -> NULL), any other is taken as it is."""
    return parse_timestamp(col(name)) if isinstance(df.schema[name].dataType, T.StringType) else col(name)


def date_text_cols(df: DataFrame) -> list[str]:
    strings = set(categorical_cols(df))
    return [c for c in df.columns if c in strings and any(k in c.lower() for k in DATE_PARSE_KEYWORDS)]


def parse_dates(df: DataFrame, formats: list[str] | None = None, strict: bool = False,
                cols: list[str] | None = None) -> DataFrame:
    """Text columns named like dates -> timestamp; bad values -> NULL.

    ``strict``: all-or-nothing per column — if any non-NULL value fails to
    parse, the column is left as it was. Decided by one one-row aggregate.
    """
    targets = cols if cols is not None else date_text_cols(df)
    if not targets:
        return df
    keep = set(targets)
    if strict:
        bad = df.agg(*[F.count_if(parse_timestamp(col(c), formats).isNull() & col(c).isNotNull()).alias(c)
                       for c in targets]).first()
        keep = {c for c in targets if bad[c] == 0}
    return df.select([parse_timestamp(col(c), formats).alias(c) if c in keep else col(c) for c in df.columns])


def strip_whitespace(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    targets = set(cols if cols is not None else categorical_cols(df))
    return df.select([F.regexp_replace(col(c), _EDGE_WS, "").alias(c) if c in targets else col(c)
                      for c in df.columns])


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    d = normalize_nulls(df)
    counts = d.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(d.columns)]).first()
    empty = [c for i, c in enumerate(d.columns) if counts[f"c{i}"] == 0]
    return df.drop(*empty), empty


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _numeric_fill_values(df: DataFrame, strategy: str, missing: dict | None = None) -> tuple[dict, dict]:
    """NULL count (unless given) and fill value for every numeric column."""
    nums = numeric_cols(df)
    if not nums:
        return {}, {}
    d = normalize_nulls(df.select(*[col(c) for c in nums]))
    aggs = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(nums)]
    if missing is not None:
        aggs = [F.lit(missing[c]).alias(f"n{i}") for i, c in enumerate(nums)]
    if strategy == "median":
        med = quantile_row(d, nums, [0.5]).first()  # exact, distributed
    elif strategy == "mean":
        aggs += [F.avg(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(nums)]
    row = d.agg(*aggs).first() if (missing is None or strategy == "mean") else None
    if missing is not None:
        missing = {c: missing[c] for c in nums}
    else:
        missing = {c: row[f"n{i}"] for i, c in enumerate(nums)}
    if strategy == "median":
        values = {c: med[f"q{i}_0"] for i, c in enumerate(nums)}
    elif strategy == "mean":
        values = {c: row[f"v{i}"] for i, c in enumerate(nums)}
    else:
        values = {c: 0.0 for c in nums}
    return missing, values


def fill_numeric(df: DataFrame, strategy: str = "median",
                 missing: dict | None = None) -> tuple[DataFrame, list[tuple[str, int, float]]]:
    """Impute numeric NULLs (NaN counts as NULL). Columns that had NULLs
    become double, as the fill may be fractional; an all-NULL column stays
    NULL for median / mean. Returns (frame, [(column, filled, value)])."""
    missing, values = _numeric_fill_values(df, strategy, missing)
    todo = {c: values[c] for c, m in missing.items() if m > 0 and values[c] is not None}
    out = normalize_nulls(df).select([
        F.coalesce(col(c).cast("double"), F.lit(float(todo[c]))).alias(c) if c in todo else col(c)
        for c in df.columns])
    return out, [(c, missing[c], float(todo[c])) for c in df.columns if c in todo]


def fill_categorical(df: DataFrame, strategy: str = "mode",
                     missing: dict | None = None) -> tuple[DataFrame, list[tuple[str, int, str]]]:
    """Impute text NULLs with the column mode (smallest of tied modes) or
    'Unknown' (no mode, or by choice)."""
    strings = categorical_cols(df)
    if not strings:
        return df, []
    if missing is not None:
        row = {f"n{i}": missing[c] for i, c in enumerate(strings)}
    else:
        row = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(strings)]).first()
    need = [c for i, c in enumerate(strings) if row[f"n{i}"] > 0]
    found = {}
    if strategy == "mode" and need:
        found = {r["column_name"]: r["mode"] for r in modes(df, need).collect()}  # <= one row per column
    fills = {}
    for i, c in enumerate(strings):
        if row[f"n{i}"] > 0:
            m = found.get(c)
            fills[c] = (row[f"n{i}"], m if m is not None else UNKNOWN_FILL)
    out = df.select([F.coalesce(col(c), F.lit(fills[c][1])).alias(c) if c in fills else col(c)
                     for c in df.columns])
    return out, [(c, fills[c][0], fills[c][1]) for c in df.columns if c in fills]


@dataclass
class Known:
    """What one aggregate over the de-duplicated table tells the later steps."""

    rows: int
    missing: dict[str, int]  # NULLs by column
    dates: dict[str, int]  # values that parse, by text column named like a date


#: What a step did: (column, cells or columns concerned, value used).
Done = list[tuple[str, int, str | None]]
Step = Callable[[DataFrame, Known], tuple[DataFrame, Done]]


def numbers(strategy: str = "median") -> Step:
    """Fill NULLs of numeric columns with their median or mean, or with zero."""
    def fill_numbers(df: DataFrame, known: Known) -> tuple[DataFrame, Done]:
        out, done = fill_numeric(df, strategy, known.missing)
        return out, [(c, n, f"{v:.2f}") for c, n, v in done]
    return fill_numbers


def texts(strategy: str = "mode") -> Step:
    """Fill NULLs of text columns with their mode or with the word for unknown."""
    def fill_texts(df: DataFrame, known: Known) -> tuple[DataFrame, Done]:
        return fill_categorical(df, strategy, known.missing)
    return fill_texts


def dates(formats: list[str] | None = None) -> Step:
    """Turn text columns named like dates into timestamps."""
    def read_dates(df: DataFrame, known: Known) -> tuple[DataFrame, Done]:
        return parse_dates(df, formats, cols=[*known.dates]), [(c, n, None) for c, n in known.dates.items()]
    return read_dates


def edges() -> Step:
    """Take white space off both ends of texts."""
    def strip_edges(df: DataFrame, known: Known) -> tuple[DataFrame, Done]:
        strings = categorical_cols(df)
        return strip_whitespace(df, strings), [(c, known.rows, None) for c in strings]
    return strip_edges


def empties() -> Step:
    """Drop columns without a value; the known counts decide, no row is read for it."""
    def drop_empties(df: DataFrame, known: Known) -> tuple[DataFrame, Done]:
        date = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
        nothing = [c for c in df.columns if (known.dates[c] == 0 if c in date and c in known.dates
                                             else known.rows == known.missing[c] and not isinstance(df.schema[c].dataType, T.StringType))]
        # a text column without a value has been filled, unless texts() was left out
        nothing += [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType) and known.rows == known.missing[c] and c not in known.dates
                    and df.select(col(c)).where(col(c).isNotNull()).isEmpty()]
        return df.drop(*nothing), [(c, known.rows, None) for c in df.columns if c in nothing]
    return drop_empties


def standard_steps() -> list[Step]:
    return [numbers(), texts(), dates(), edges(), empties()]


def clean(df: DataFrame, steps: list[Step] | None = None, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """De-duplicate (unless ``distinct`` is off) and run the steps in order.

    Returns the cleaned frame and a report of one row per fact: (ord, step,
    column_name, amount, value). Facts are the rows and columns before and
    after, the duplicate rows taken out, and per step and column the cells or
    columns it concerned and the value it used. The table is written once to the
    shared folder after de-duplication; one aggregate over it serves all steps.
    """
    spark = df.sparkSession
    cur = normalize_nulls(df)
    cur = materialize(drop_duplicates(cur) if distinct else cur, "clean")
    named = date_text_cols(cur)
    row = cur.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(col(c)).alias(f"_c{i}") for i, c in enumerate(cur.columns)],
                  *[F.count(parse_timestamp(col(c))).alias(f"_d{i}") for i, c in enumerate(named)]).first()
    known = Known(row["_rows"], {c: row["_rows"] - row[f"_c{i}"] for i, c in enumerate(cur.columns)}, {c: row[f"_d{i}"] for i, c in enumerate(named)})
    facts: list[tuple] = []
    for step in standard_steps() if steps is None else steps:
        cur, done = step(cur, known)
        facts += [(step.__name__, c, n, v) for c, n, v in done]
    facts = [("rows_after", None, known.rows, None), ("columns_before", None, len(df.columns), None), ("columns_after", None, len(cur.columns), None), *facts]
    kind = "ord int, step string, column_name string, amount long, value string"
    fixed = spark.createDataFrame([(i + 2, *x) for i, x in enumerate(facts)], kind)
    before = df.agg(F.count(F.lit(1)).cast("long").alias("n"))  # counted only if the report is read
    lazy = before.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("step"), F.lit(None).cast("string").alias("column_name"), amount.alias("amount"), F.lit(None).cast("string").alias("value"))
        for i, (name, amount) in enumerate((("rows_before", F.col("n")), ("duplicates", F.col("n") - F.lit(known.rows))))])).alias("x")).select("x.*")
    return cur, lazy.unionByName(fixed)


def narrow_types(df: DataFrame, float_tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Smallest integer type that holds each integer column's min/max; doubles
    to float when the round trip error stays within ``float_tolerance``
    (relative). Decided by one aggregate; returns (frame, actions frame)."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))]
    dbls = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    aggs = []
    for i, c in enumerate(ints):
        aggs += [F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}")]
    for i, c in enumerate(dbls):
        x = col(c)
        err = F.abs(x - x.cast("float").cast("double")) / F.greatest(F.abs(x), F.lit(1.0))
        aggs.append(F.max(err).alias(f"e{i}"))
    casts, actions = {}, []
    if aggs:
        row = normalize_nulls(df).agg(*aggs).first()
        for i, c in enumerate(ints):
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo is None:
                continue
            for name, lim in (("tinyint", 127), ("smallint", 32767), ("int", 2147483647)):
                if -lim - 1 <= lo and hi <= lim:
                    if name != df.schema[c].dataType.simpleString():
                        casts[c] = name
                    break
        for i, c in enumerate(dbls):
            e = row[f"e{i}"]
            if e is not None and e <= float_tolerance:
                casts[c] = "float"
    for c in df.columns:
        if c in casts:
            actions.append((c, df.schema[c].dataType.simpleString(), casts[c]))
    out = df.select([col(c).cast(casts[c]).alias(c) if c in casts else col(c) for c in df.columns])
    schema = "column_name string, from_type string, to_type string"
    return out, df.sparkSession.createDataFrame(actions, schema)
