"""Source / sink / history queries (S1-S20). Every writing query uses a fresh
folder under the shared checkpoint directory, never a machine-local path
and never the input folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.q_eda import _pairs_sql
from tessera.plans.q_questions import SALES_NUM
from tessera.plans.views import TABLES, sales, table, with_sales
from tessera.session import scratch_path
from tessera.sources import csv, history as hist, json as js, report, tables
from tessera.streaming import ingest


def _csv_fixture(spark, d):
    """Three CSV data sets written from the driver tables: comma / UTF-8,
    semicolon / Latin-1, tab / UTF-8."""
    root = scratch_path(spark, "csv")
    csv.write_csv(table(spark, d, "orders"), f"{root}/orders")
    csv.write_csv(table(spark, d, "conversations"), f"{root}/conversations", sep=";", encoding="ISO-8859-1")
    csv.write_csv(table(spark, d, "customer"), f"{root}/customer", sep="\t")
    return root


def _dataset():
    return F.regexp_extract(F.col("file_path"), r"/([^/]+)/[^/]+$", 1)


@register("csv_roundtrip")
def csv_roundtrip(spark, d):
    src = table(spark, d, "orders")
    root = scratch_path(spark, "csv_rt")
    csv.write_csv(src, root)
    back = csv.read_csv(spark, root)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in src.schema.fields])


oracle("csv_roundtrip", "SELECT * FROM orders")


@register("csv_mixed_folder")
def csv_mixed_folder(spark, d):
    """One folder with a comma / UTF-8 and a semicolon / Latin-1 part."""
    root = scratch_path(spark, "csv_mixed")
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"), F.when(F.col("lang") == "fr", "été; ä").otherwise("a, b").alias("note"))
    csv.write_csv(docs.where("doc_id % 2 = 0"), f"{root}/even")
    csv.write_csv(docs.where("doc_id % 2 <> 0"), f"{root}/odd", sep=";", encoding="ISO-8859-1")
    back = csv.read_csv(spark, root)
    return back.select(F.col("doc_id").cast("long"), "lang", F.col("n").cast("long"), "note")


oracle("csv_mixed_folder", """
SELECT doc_id, lang, CAST(LENGTH(text) AS BIGINT) AS n, CASE WHEN lang = 'fr' THEN 'été; ä' ELSE 'a, b' END AS note FROM documents""")


@register("csv_encodings")
def csv_encodings(spark, d):
    e = csv.csv_encodings(spark, _csv_fixture(spark, d))
    # a part without a letter beyond ASCII is valid UTF-8 in either encoding: a data set is what any of its parts is
    return e.groupBy(_dataset().alias("dataset")).agg(F.min("encoding").alias("encoding"))


oracle("csv_encodings", r"""
SELECT 'orders' AS dataset, 'utf-8' AS encoding UNION ALL SELECT 'customer', 'utf-8' UNION ALL
SELECT 'conversations', CASE WHEN COUNT(*) FILTER (regexp_matches(text, '[^\x00-\x7F]')) > 0 THEN 'latin-1' ELSE 'utf-8' END FROM conversations""")


@register("csv_delimiters")
def csv_delimiters(spark, d):
    e = csv.csv_delimiters(spark, _csv_fixture(spark, d))
    return e.groupBy(_dataset().alias("dataset"), "delimiter").agg((F.count(F.lit(1)) > 0).alias("found"))


oracle("csv_delimiters", """
SELECT * FROM (SELECT 'orders' AS dataset, ',' AS delimiter, COUNT(*) > 0 AS found FROM orders UNION ALL
SELECT 'conversations', ';', COUNT(*) > 0 FROM conversations UNION ALL
SELECT 'customer', chr(9), COUNT(*) > 0 FROM customer) WHERE found""")


@register("csv_inventory")
def csv_inventory(spark, d):
    inv = csv.csv_inventory(spark, _csv_fixture(spark, d))
    # files and bytes depend on how the fixture was split when it was written
    return inv.groupBy(_dataset().alias("dataset")).agg(
        F.min("encoding").alias("encoding"), F.sum("rows").cast("long").alias("rows"),
        (F.sum("lines") >= F.sum("rows") + F.count(F.lit(1))).alias("lines_cover_records"),
        (F.abs(F.sum("row_estimate") + F.count(F.lit(1)) - F.sum("lines")) <= F.count(F.lit(1)) + F.sum("lines") / 100).alias("estimate_is_lines"))


oracle("csv_inventory", " UNION ALL ".join(f"""
SELECT '{name}' AS dataset, {encoding} AS encoding, CAST(COUNT(*) AS BIGINT) AS rows, TRUE AS lines_cover_records, TRUE AS estimate_is_lines FROM {name}"""
    for name, encoding in (("orders", "'utf-8'"), ("customer", "'utf-8'"),
                           ("conversations", r"CASE WHEN COUNT(*) FILTER (regexp_matches(text, '[^\x00-\x7F]')) > 0 THEN 'latin-1' ELSE 'utf-8' END"))))


@register("csv_record_counts")
def csv_record_counts(spark, d):
    """Conversations with line breaks and quotes inside quoted fields, written as CSV and counted split by split."""
    root = scratch_path(spark, "csv")
    lines = table(spark, d, "conversations").withColumn("text", F.concat(F.col("text"), F.lit('\n\n"quoted", '), F.col("role"), F.lit("\r\nend")))
    lines.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(root)
    return csv.csv_inventory(spark, root).agg(F.sum("rows").cast("long").alias("rows"), (F.sum("lines") > F.sum("rows")).alias("spans_lines"))


oracle("csv_record_counts", "SELECT CAST(COUNT(*) AS BIGINT) AS rows, TRUE AS spans_lines FROM conversations")


@register("sql_query")
def sql_query(spark, d):
    tables.register_views(spark, {"orders": table(spark, d, "orders")})
    return tables.read_query(spark, """
        SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS orders, ROUND(SUM(o_totalprice), 2) AS total_price
        FROM orders GROUP BY o_orderpriority""")


oracle("sql_query", """
SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS orders, ROUND(SUM(o_totalprice), 2) AS total_price
FROM orders GROUP BY o_orderpriority""")


@register("table_counts")
def table_counts(spark, d):
    tables.register_views(spark, {t: table(spark, d, t) for t in TABLES})
    return tables.table_counts(spark, TABLES)


oracle("table_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT CAST(COUNT(*) AS BIGINT) FROM (DESCRIBE {t})) AS column_count, "
    f"CAST(COUNT(*) AS BIGINT) AS rows FROM {t}" for t in TABLES))


@register("catalog_metadata")
def catalog_metadata(spark, d):
    tables.register_views(spark, {t: table(spark, d, t) for t in TABLES})
    return tables.catalog_metadata(spark, TABLES)


_SPARK_TYPE = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
  WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'FLOAT[]' THEN 'array<float>'
  WHEN 'DOUBLE[]' THEN 'array<double>' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'FLOAT' THEN 'float' WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint' END"""
oracle("catalog_metadata", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS table_name, CAST(ROW_NUMBER() OVER () - 1 AS INTEGER) AS position, column_name, {_SPARK_TYPE} AS data_type,
  "null" = 'YES' AS nullable, (SELECT CAST(COUNT(*) AS BIGINT) FROM {t}) AS rows FROM (DESCRIBE {t})""" for t in TABLES))


@register("events_props_flatten")
def events_props_flatten(spark, d):
    return js.parse_json_col(table(spark, d, "events").select("event_id", "props"), "props")


oracle("events_props_flatten", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")


@register("json_path")
def json_path(spark, d):
    o = table(spark, d, "orders")
    nested = o.select("o_orderkey", F.struct("o_custkey", "o_orderstatus",
                                             F.struct("o_totalprice", "o_orderpriority").alias("price")).alias("detail"))
    root = scratch_path(spark, "json")
    nested.write.mode("overwrite").json(root)
    return js.read_json(spark, root, "detail")


oracle("json_path", """
SELECT o_custkey, o_orderstatus, o_totalprice AS "price.o_totalprice", o_orderpriority AS "price.o_orderpriority"
FROM orders""")


def _sheet(name):
    """One sheet of the sales report, written and read back."""
    def run(spark, d):
        paths = report.report_bundle(sales(spark, d), scratch_path(spark, "report"), only=[name])
        return spark.read.parquet(paths[name])
    return run


for _name in ("raw_data", "statistics", "correlations", "category_summary"):
    register(f"report_{_name}")(_sheet(_name))

oracle("report_raw_data", with_sales("SELECT * FROM sales"))
oracle("report_statistics", with_sales(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(COUNT({c}) AS BIGINT) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,
       ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS min, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25), 4) AS q25, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
       ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75), 4) AS q75, ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS max FROM sales""" for c in SALES_NUM)))
oracle("report_correlations", with_sales(f"SELECT col1, col2, correlation FROM ({_pairs_sql('sales', SALES_NUM)})"))
oracle("report_category_summary", with_sales("""
SELECT product, ROUND(SUM(CAST(order_id AS DOUBLE)), 2) AS sum, ROUND(AVG(order_id), 2) AS mean, CAST(COUNT(order_id) AS BIGINT) AS count
FROM sales WHERE product IS NOT NULL GROUP BY product"""))


@register("report_category_counts")
def report_category_counts(spark, d):
    """The whole bundle is written, one sheet read back."""
    paths = report.report_bundle(sales(spark, d), scratch_path(spark, "report"))
    return spark.read.parquet(paths["category_counts"])


oracle("report_category_counts", """
WITH sales AS (
  SELECT p_brand AS product, p_type AS category, r_name AS region
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)
SELECT 'product' AS column_name, product AS value, CAST(COUNT(*) AS BIGINT) AS count FROM sales
  WHERE product IS NOT NULL GROUP BY product
UNION ALL SELECT 'category', category, CAST(COUNT(*) AS BIGINT) FROM sales WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT 'region', region, CAST(COUNT(*) AS BIGINT) FROM sales WHERE region IS NOT NULL GROUP BY region""")


def _history_rows(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("entry_id"),
                    F.col("turn").alias("created_at"), F.col("role"), F.col("text"))


@register("history_latest")
def history_latest(spark, d):
    base = scratch_path(spark, "history")
    rows = _history_rows(spark, d)
    hist.append_history(rows.select("session_id", "entry_id", "created_at",
                                    F.col("role").alias("analysis_type"), F.col("text").alias("query")), base)
    return hist.history(spark, base, limit=50).select("session_id", "entry_id", "analysis_type")


oracle("history_latest", """
SELECT session_id, entry_id, analysis_type FROM (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS entry_id, role AS analysis_type,
         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, turn) AS rn FROM conversations)
WHERE rn <= 50""")


@register("chat_history")
def chat_history(spark, d):
    base = scratch_path(spark, "chat")
    rows = _history_rows(spark, d)
    hist.append_chat(rows.select("session_id", "entry_id", "created_at", "role", F.col("text").alias("content")), base)
    return hist.chat(spark, base, limit=100).select("session_id", "entry_id", "role", "content")


oracle("chat_history", """
SELECT session_id, entry_id, role, content FROM (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS entry_id, role, text AS content,
         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, turn) AS rn FROM conversations)
WHERE rn <= 100""")


@register("chat_cleared")
def chat_cleared(spark, d):
    """Sessions whose number 3 divides are cleared, then speak once more."""
    base = scratch_path(spark, "chat")
    rows = _history_rows(spark, d).select("session_id", "entry_id", "created_at", "role", F.col("text").alias("content"))
    hist.append_chat(rows, base)
    gone = rows.where(F.col("session_id").cast("long") % 3 == 0)
    hist.clear_chats(spark, base, gone.select("session_id"))
    hist.append_chat(gone.groupBy("session_id").agg(F.max("entry_id").alias("last")).select(
        "session_id", (F.col("last") + 1).alias("entry_id"), (F.col("last") + 1).alias("created_at"), F.lit("user").alias("role"), F.lit("again").alias("content")), base)
    return hist.chat(spark, base, limit=1000).groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), F.min("entry_id").cast("long").alias("first_entry"))


oracle("chat_cleared", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE LEAST(COUNT(*), 1000) END AS entries,
       CAST(CASE WHEN conv_id % 3 = 0 THEN MAX(turn) + 1 ELSE MIN(turn) END AS BIGINT) AS first_entry
FROM conversations GROUP BY conv_id""")


@register("history_stats")
def history_stats(spark, d):
    base = scratch_path(spark, "hstats")
    rows = _history_rows(spark, d)
    hist.append_chat(rows.select("session_id", "entry_id", "created_at", "role", F.col("text").alias("content")), base)
    hist.append_history(rows.where(F.col("role") == "user").select(
        "session_id", "entry_id", "created_at", F.col("role").alias("analysis_type"), F.col("text").alias("query")),
        base)
    return hist.history_stats(spark, base)


oracle("history_stats", """
SELECT 'analysis_history' AS table_name, CAST(COUNT(*) FILTER (WHERE role = 'user') AS BIGINT) AS rows
FROM conversations
UNION ALL SELECT 'chat_history', CAST(COUNT(*) AS BIGINT) FROM conversations
UNION ALL SELECT 'model_registry', CAST(0 AS BIGINT)
UNION ALL SELECT 'data_profiles', CAST(0 AS BIGINT)""")


@register("chat_stream_ingest")
def chat_stream_ingest(spark, d):
    landing = scratch_path(spark, "landing")
    rows = _history_rows(spark, d).select("session_id", "entry_id", "role", F.col("text").alias("content"))
    rows.write.mode("overwrite").json(landing)
    schema = "session_id string, entry_id long, role string, content string"
    out = ingest.ingest_now(spark, landing, schema, scratch_path(spark, "chat_stream"),
                            scratch_path(spark, "chat_stream_ckpt"), partition_by=["session_id"])
    return out.groupBy("role").agg(F.count(F.lit(1)).cast("long").alias("messages"))


oracle("chat_stream_ingest", "SELECT role, CAST(COUNT(*) AS BIGINT) AS messages FROM conversations GROUP BY role")


@register("model_versions")
def model_versions(spark, d):
    """Registering one model per order priority twice: versions 1 then 2."""
    base = scratch_path(spark, "models")
    o = table(spark, d, "orders")
    models = o.groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.max("o_orderdate").alias("created_at"), F.count(F.lit(1)).alias("n_rows")).select(
        "name", F.lit("classification").alias("model_type"), "created_at",
        F.to_json(F.struct("n_rows")).alias("metrics"))
    hist.register_models(spark, base, models)
    hist.register_models(spark, base, models)
    return hist.read(spark, base, "model_registry").groupBy("name").agg(
        F.max("version").cast("long").alias("latest_version"), F.count(F.lit(1)).cast("long").alias("registrations"))


oracle("model_versions", """
SELECT o_orderpriority AS name, CAST(2 AS BIGINT) AS latest_version, CAST(2 AS BIGINT) AS registrations
FROM orders GROUP BY o_orderpriority""")


@register("profile_saved")
def profile_saved(spark, d):
    """Save the column profile of the dirty sales fixture as JSON rows, read back."""
    from tessera.operators import profile
    from tessera.plans.views import sales_dirty
    base = scratch_path(spark, "profiles")
    dirty = sales_dirty(spark, d)
    hist.save_profile(profile.column_profile(dirty), base, "sales_dirty", dirty)
    saved = hist.read(spark, base, "data_profiles")
    return saved.select("dataset", F.get_json_object("profile_json", "$.column_name").alias("column_name"),
                        F.get_json_object("profile_json", "$.missing_count").cast("long").alias("missing_count"), "total_rows", "total_columns", "quality_score")


def _profile_saved_sql() -> str:
    from tessera.plans.oracle import ORACLE
    from tessera.plans import q_profile  # noqa: F401 - registers missing_by_column
    return (f"SELECT 'sales_dirty' AS dataset, m.column_name, m.missing_count, v.total_rows, v.total_columns, q.quality_score FROM ({ORACLE['missing_by_column']}) m, "
            f"({ORACLE['validate_dataset']}) v, ({ORACLE['quality_score']}) q")


oracle("profile_saved", _profile_saved_sql())


@register("model_store")
def model_store(spark, d):
    """Train, store and load a linear model; measures of its scores over the whole table."""
    from tessera.operators import ml
    from tessera.sources import models
    base, rows = scratch_path(spark, "models"), table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    models.train_and_store(spark, base, "price", rows, "l_extendedprice", ["l_quantity"], test_frac=0.0)
    scored = models.score(spark, base, "price", rows)
    return ml.regression_metrics(scored.withColumnRenamed("l_extendedprice", "label"), digits=2)


oracle("model_store", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, AVG(l_extendedprice) AS m FROM lineitem)
SELECT ROUND(AVG(ABS(l_extendedprice - a - b * l_quantity)), 2) AS mae, ROUND(SQRT(AVG((l_extendedprice - a - b * l_quantity) ** 2)), 2) AS rmse,
       ROUND(1 - SUM((l_extendedprice - a - b * l_quantity) ** 2) / SUM((l_extendedprice - m) ** 2), 2) AS r2, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem, f""")


@register("profile_merged")
def profile_merged(spark, d):
    """The saved profile of half the line items merged with that of the other half; sketch figures against exact ones."""
    from tessera.operators import sketches
    from tessera.session import materialize
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    half = F.col("l_quantity") < 20
    saved = materialize(sketches.profile_state(rows.where(half)), "profile-state")
    found = sketches.read_state(sketches.merge_states(saved.unionByName(sketches.profile_state(rows.where(~half)))))
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in rows.columns])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("u")) for c in rows.columns])).alias("x")).select("x.*")
    return found.join(F.broadcast(exact), F.col("column_name") == F.col("c")).select(
        "column_name", "rows", "missing", F.round("mean", 2).alias("mean"), "least", "greatest",
        (F.abs(F.col("distinct") - F.col("u")) <= 0.06 * F.col("u") + 1).alias("distinct_ok"),
        F.when(F.col("u") <= 50, F.col("top")[0]["value"]).alias("most_frequent"), F.when(F.col("u") <= 50, F.col("top")[0]["count"]).alias("times"))


def _merged_sql(c: str, number: bool) -> str:
    value = f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)" if number else c
    mean, least, greatest = (f"ROUND(AVG({c}), 2)", f"MIN({c})", f"MAX({c})") if number else ("CAST(NULL AS DOUBLE)",) * 3
    return f"""SELECT '{c}' AS column_name, CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing, {mean} AS mean, {least} AS least,
  {greatest} AS greatest, TRUE AS distinct_ok,
  CASE WHEN COUNT(DISTINCT {c}) <= 50 THEN (SELECT v FROM (SELECT {value} AS v, COUNT(*) AS k FROM lineitem GROUP BY {c}) ORDER BY k DESC, v LIMIT 1) END AS most_frequent,
  CASE WHEN COUNT(DISTINCT {c}) <= 50 THEN (SELECT CAST(MAX(k) AS BIGINT) FROM (SELECT COUNT(*) AS k FROM lineitem GROUP BY {c})) END AS times FROM lineitem"""


oracle("profile_merged", " UNION ALL ".join(_merged_sql(c, n) for c, n in (("l_quantity", True), ("l_extendedprice", True), ("l_returnflag", False), ("l_linestatus", False))))
