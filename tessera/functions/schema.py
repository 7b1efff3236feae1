"""Column classes and role detection by name.

These are driver-side walks over ``df.schema`` (no data is touched). The
column classes follow the pandas notions the analyses are defined in:
*numeric* = number types without boolean, *categorical* = strings, and a
*date* column is found by its name, not its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values (must equal the analysed application's keyword table) ----
# Role -> keywords, in this order; matching is a lower-case substring test.
ROLE_KEYWORDS: dict[str, list[str]] = {
    "sales": ["sales", "revenue", "amount", "total_sales", "gross_sales"],
    "profit": ["profit", "margin", "income", "net_income", "earnings"],
    "quantity": ["quantity", "qty", "units", "count", "volume"],
    "date": ["date", "time", "timestamp", "order_date", "created_at", "datetime"],
    "category": ["category", "type", "segment", "group", "class", "department"],
    "region": ["region", "state", "location", "city", "area", "country", "territory"],
    "product": ["product", "item", "name", "sku", "product_name"],
    "customer": ["customer", "client", "buyer", "user", "customer_id", "account"],
    "price": ["price", "cost", "unit_price", "rate", "fee"],
    "id": ["id", "order_id", "transaction_id", "invoice"],
}
# Keywords the cleaner uses to decide which text columns hold dates.
DATE_PARSE_KEYWORDS = ["date", "time", "timestamp"]
# --- end of fixed values ---------------------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType, include_bool: bool = False) -> bool:
    if include_bool and isinstance(dt, T.BooleanType):
        return True
    return isinstance(dt, _NUMERIC)


def numeric_cols(df: DataFrame, include_bool: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType, include_bool)]


def categorical_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def timestamp_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def date_cols(df: DataFrame) -> list[str]:
    kws = ROLE_KEYWORDS["date"]
    return [c for c in df.columns if any(k in c.lower() for k in kws)]


def role_of(name: str) -> str:
    """Role-major search: first role whose keyword list hits the name."""
    low = name.lower()
    for role, kws in ROLE_KEYWORDS.items():
        if any(k in low for k in kws):
            return role
    return "unknown"


def find_col(df: DataFrame, role: str, numeric: bool = False) -> str | None:
    """Keyword-major search: first keyword, then first column containing it."""
    fields = df.schema.fields
    for kw in ROLE_KEYWORDS[role]:
        for f in fields:
            if kw in f.name.lower() and (not numeric or is_numeric_type(f.dataType, True)):
                return f.name
    return None


def role_expr(name_col: str = "column_name"):
    """The role rule as a Column expression over a table of column names."""
    low = F.lower(F.col(name_col))
    expr = F.lit("unknown")
    for role, kws in reversed(list(ROLE_KEYWORDS.items())):
        hit = None
        for k in kws:
            c = low.contains(k)
            hit = c if hit is None else (hit | c)
        expr = F.when(hit, F.lit(role)).otherwise(expr)
    return expr


def column_roles(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(column_name, data_type, role) for every column of ``df``."""
    spark = spark or df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    names = spark.createDataFrame(rows, "position int, column_name string, data_type string")
    return names.withColumn("role", role_expr("column_name"))


def q(name: str):
    """Column by a possibly dotted / spaced name."""
    return F.col(f"`{name}`")
