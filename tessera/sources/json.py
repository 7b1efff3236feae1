"""JSON sources (S10, S11): JSON-lines files and JSON text columns, with
nested structs flattened to dotted column names (arrays kept as values).

The schema of a JSON text column is inferred by Spark itself with
``schema_of_variant_agg`` over all rows (a mergeable aggregate), so no sample
is pulled to the driver; only the resulting DDL string is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct columns -> flat columns named 'a.b.c'; arrays kept."""
    out = []

    def walk(prefix: str, path: str, dt: T.DataType):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(f"{prefix}{sep}{f.name}" if prefix else f.name, f"{path}.`{f.name}`" if path else f"`{f.name}`",
                     f.dataType)
        else:
            out.append(F.col(path).alias(prefix))

    for f in df.schema.fields:
        walk(f.name, f"`{f.name}`", f.dataType)
    return df.select(*out)


def json_schema_of(df: DataFrame, col: str) -> str:
    """Merged schema (DDL) of every JSON document in ``col``."""
    v = df.select(F.try_parse_json(F.col(f"`{col}`")).alias("_v")).where(F.col("_v").isNotNull())
    ddl = v.agg(F.schema_of_variant_agg("_v").alias("s")).first()["s"]
    # variant schemas spell structs as OBJECT<...>; the DDL parser wants STRUCT<...>
    return (ddl or "STRUCT<>").replace("OBJECT<", "STRUCT<")


def parse_json_col(df: DataFrame, col: str, sep: str = ".") -> DataFrame:
    """Replace the JSON text column by its flattened fields ('col.key');
    missing keys and unparsable rows give NULL."""
    ddl = json_schema_of(df, col)
    parsed = df.withColumn(col, F.from_json(F.col(f"`{col}`"), ddl))
    return flatten(parsed, sep)


def read_json(spark: SparkSession, path: str, json_path: str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON records; optionally drill along a dotted path (error when a key
    is missing). An array of records is exploded into rows, a record becomes
    its fields, an array of scalars becomes a column ``value``."""
    df = spark.read.option("multiLine", multi_line).json(path)
    if json_path:
        cur = df
        for key in json_path.split("."):
            names = {f.name: f.dataType for f in cur.schema.fields}
            if key not in names:
                raise KeyError(f"'{key}' not found in JSON path '{json_path}'")
            dt = names[key]
            if isinstance(dt, T.ArrayType):
                cur = cur.select(F.explode(F.col(f"`{key}`")).alias(key))
                dt = dt.elementType
            else:
                cur = cur.select(F.col(f"`{key}`").alias(key))
            if isinstance(dt, T.StructType):
                cur = cur.select(f"`{key}`.*")
            else:
                cur = cur.select(F.col(f"`{key}`").alias("value"))
        df = cur
    return flatten(df)
