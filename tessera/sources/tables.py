"""Table sources: catalog tables, SQL text, JDBC.

``read_jdbc`` is the distributed replacement for the single-connection SQL
reader: with a numeric ``partition_column`` and bounds, Spark opens
``num_partitions`` parallel range queries. (No database is started by this
repository; the JDBC path is exercised only against a caller's server.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
    df = spark.table(name)
    return df.limit(int(limit)) if limit is not None else df


def read_query(spark: SparkSession, sql: str) -> DataFrame:
    if not sql or not sql.strip():
        raise ValueError("either a table name or a SELECT statement is required")
    return spark.sql(sql)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int = 8,
              properties: dict | None = None) -> DataFrame:
    if not (table or query):
        raise ValueError("either table or query is required")
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:  # a query is read in parallel like a table, as a derived table
        return (r.option("dbtable", table or f"({query}) q").option("partitionColumn", partition_column).option("lowerBound", lower_bound)
                .option("upperBound", upper_bound).option("numPartitions", num_partitions).load())
    return (r.option("dbtable", table) if table else r.option("query", query)).load()


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def catalog_metadata(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(table_name, position, column_name, data_type, nullable, rows) of the catalog's tables and views, or of those in
    ``names``: types and nullability as the catalog lists them, row counts from one aggregate per table in one job."""
    listed = sorted(t.name for t in spark.catalog.listTables() if names is None or t.name in names)
    missing = sorted(set(names or []) - set(listed))
    if missing:
        raise ValueError(f"not in the catalog: {', '.join(missing)}")
    columns = [(t, i, c.name, c.dataType, c.nullable) for t in listed for i, c in enumerate(spark.catalog.listColumns(f"`{t}`"))]
    out = spark.createDataFrame(columns, "table_name string, position int, column_name string, data_type string, nullable boolean")
    counts = spark.createDataFrame([], "_table string, rows long")
    for t in listed:
        counts = counts.unionByName(spark.table(f"`{t}`").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("_table"), "rows"))
    return out.join(F.broadcast(counts), F.col("table_name") == F.col("_table"), "left").drop("_table")  # a row per table


def table_counts(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(table_name, column_count, rows) of the catalog's tables and views."""
    return catalog_metadata(spark, names).groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"), F.max("rows").alias("rows"))
