"""Missing-value rules.

pandas treats NaN, None and NaT as one notion of "missing" and skips it in
every aggregate. Spark keeps NaN as a value (``avg`` of a column holding NaN
is NaN), so every operator starts by turning floating NaN into SQL NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_nulls(df: DataFrame) -> DataFrame:
    """float/double NaN -> NULL; all other columns untouched (narrow, no shuffle)."""
    floats = {f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select([
        F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats
        else F.col(f"`{c}`")
        for c in df.columns
    ])
