"""Fixture views over the driver tables.

The analysed application works on one flat *sales* table whose column names
carry the business roles. ``sales`` builds that table from the star schema;
``sales_dirty`` derives deterministic dirt (missing values, padded text,
unparsable dates, duplicates) from it for the cleaning and quality operators.

Join strategy: ``nation`` and ``region`` are fixed-size dimension tables
(25 and 5 rows at every scale factor), so they are joined to each other and
broadcast explicitly. ``part`` and ``customer`` grow with the scale factor;
for those Spark's size-checked planner (``autoBroadcastJoinThreshold`` + AQE)
decides between broadcast and a shuffled join at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation ⋈ region: fixed 25 rows by construction of the schema."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    g = geo(spark, sf_dir)
    cust = c.join(F.broadcast(g), c.c_nationkey == g.n_nationkey).select("c_custkey", "r_name")
    # orders meet their customers first, so that lineitem is not dealt out once more by customer
    oc = o.join(cust, o.o_custkey == cust.c_custkey)
    j = (li.join(oc, li.l_orderkey == oc.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_orderdate").alias("order_date"),
        F.col("c_custkey").alias("customer_id"),
        F.col("p_brand").alias("product"),
        F.col("p_type").alias("category"),
        F.col("r_name").alias("region"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("sales"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))
         - F.col("l_quantity") * F.col("p_retailprice")).alias("profit"),
        F.col("l_discount").alias("discount"),
    )


def sales_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir)
    oid = F.col("order_id")
    d = s.select(
        oid,
        F.when(oid % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(oid % 13 == 0, F.lit(None).cast("string"))
         .when(oid % 5 == 0, F.concat(F.lit("  "), F.col("region"), F.lit(" ")))
         .otherwise(F.col("region")).alias("region"),
        F.when(oid % 17 == 0, F.lit("not a date"))
         .otherwise(F.col("order_date").cast("date").cast("string")).alias("order_date_text"),
        F.when(oid % 19 == 0, F.lit("n/a"))
         .otherwise(F.col("quantity").cast("int").cast("string")).alias("amount_text"),
        F.lit(None).cast("double").alias("empty_num"),
        F.lit("x").alias("constant_text"),
    )
    # a row that is repeated comes twice from one pass: a union would join the tables twice
    times = F.explode(F.when(oid % 23 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("*", times.alias("_time")).drop("_time")


# The same fixtures, spelled for the DuckDB oracle.
SALES_SQL = """
SELECT l_orderkey AS order_id, l_linenumber AS line_no,
       o_orderdate AS order_date, c_custkey AS customer_id,
       p_brand AS product, p_type AS category, r_name AS region,
       l_quantity AS quantity, l_extendedprice AS sales,
       l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit,
       l_discount AS discount
FROM lineitem
JOIN orders   ON l_orderkey  = o_orderkey
JOIN customer ON o_custkey   = c_custkey
JOIN nation   ON c_nationkey = n_nationkey
JOIN region   ON n_regionkey = r_regionkey
JOIN part     ON l_partkey   = p_partkey
"""

SALES_DIRTY_SQL = f"""
d AS (
  SELECT order_id,
    CASE WHEN order_id % 11 = 0 THEN NULL ELSE quantity END AS quantity,
    CASE WHEN order_id % 13 = 0 THEN NULL
         WHEN order_id % 5 = 0 THEN '  ' || region || ' ' ELSE region END AS region,
    CASE WHEN order_id % 17 = 0 THEN 'not a date'
         ELSE CAST(CAST(order_date AS DATE) AS VARCHAR) END AS order_date_text,
    CASE WHEN order_id % 19 = 0 THEN 'n/a'
         ELSE CAST(CAST(quantity AS INTEGER) AS VARCHAR) END AS amount_text,
    CAST(NULL AS DOUBLE) AS empty_num, 'x' AS constant_text
  FROM sales),
sales_dirty AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE order_id % 23 = 0)
"""


def with_sales(body: str) -> str:
    return f"WITH sales AS ({SALES_SQL})\n{body}"


def with_dirty(body: str) -> str:
    return f"WITH sales AS ({SALES_SQL}),\n{SALES_DIRTY_SQL}\n{body}"
