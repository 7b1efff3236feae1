"""Column-expression building blocks shared by the operators.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage code generation and partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def month_str(c: Column) -> Column:
    """Calendar month as 'yyyy-MM' text (stable across LTZ/NTZ timestamps)."""
    return F.date_format(c, "yyyy-MM")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r over pairwise-complete rows; NULL (not an error) when either
    side is constant. ``regr_*`` skip rows where either input is NULL."""
    return F.try_divide(F.regr_sxy(b, a), F.sqrt(F.regr_sxx(b, a) * F.regr_syy(b, a)))


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness G1 (the pandas / DuckDB definition).

    Spark's ``skewness`` is the population g1; G1 = g1·√(n(n−1))/(n−2).
    NULL below 3 values, 0 for a constant column.
    """
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def sample_kurt(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas / DuckDB definition).

    G2 = (n−1)/((n−2)(n−3))·((n+1)·g2 + 6) with Spark's population g2.
    NULL below 4 values, 0 for a constant column.
    """
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.7, "strong").when(a >= 0.4, "moderate").otherwise("weak")


def stack_rows(one_row: DataFrame, rows: list[tuple[str, dict[str, Column]]],
               key: str = "column_name") -> DataFrame:
    """Turn one wide aggregate row into one row per entry of ``rows``.

    ``rows`` = [(label, {field: expr over the wide row}), ...]; every dict must
    have the same keys and compatible types. The wide row is a single row, so
    this is a narrow projection + explode, no shuffle.
    """
    fields = list(rows[0][1].keys())
    structs = [F.struct(F.lit(label).alias(key), *[exprs[f].alias(f) for f in fields])
               for label, exprs in rows]
    return one_row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def is_valid_utf8(b: Column) -> Column:
    """True when the bytes decode as UTF-8 (``try_validate_utf8`` on the binary)."""
    return F.is_valid_utf8(b.cast("string"))


def fixed(x: Column, digits: int) -> Column:
    """Text of x with ``digits`` decimals, rounded like Python's ``f'{x:.nf}'``
    (half-even on the binary value), without thousands separators."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def thousands(x: Column, digits: int = 0) -> Column:
    """Python's ``f'{x:,.nf}'``: thousands separators, half-even rounding."""
    return F.format_number(x, digits)


def signed_fixed(x: Column, digits: int) -> Column:
    """Python's ``f'{x:+.nf}'``."""
    return F.when(x >= 0, F.concat(F.lit("+"), fixed(x, digits))).otherwise(fixed(x, digits))


def sql_round(v, digits: int):
    """Round a Python float like SQL ROUND on doubles: scale, round half away
    from zero, unscale (used where a small result is finished on the driver)."""
    import math
    if v is None or (isinstance(v, float) and (math.isnan(v) or math.isinf(v))):
        return v
    m = 10.0 ** digits
    t = abs(float(v)) * m
    f = math.floor(t)
    r = f + (1.0 if t - f >= 0.5 else 0.0)
    return math.copysign(r, float(v)) / m
