"""Append-only run history (S16-S20) as Parquet tables under one base folder
(on the shared file system): analysis history, chat log, model registry and
saved profiles. Appends are file additions, reads are filtered scans.

* history / chat: per session, the newest (or oldest) ``limit`` entries —
  a salted top-k per session, so one very busy session is never sorted in a
  single task.
* model registry: version = max(version) + 1 per name, by ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.longform import top_k_per_group
from tessera.session import path_exists

# --- Fixed values: chat roles -------------------------------------------------
CHAT_ROLES = ["user", "assistant", "system"]
# --- end of fixed values ---------------------------------------------------


def _path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


#: Folders that the sessions of a table are hashed into, however many sessions there are.
SLOTS = 64


def slot(session_id):
    return F.pmod(F.xxhash64(session_id), F.lit(SLOTS)).cast("int")


def append(df: DataFrame, base: str, table: str) -> None:
    """Append rows; those of a session go to the folder its id hashes to, the id itself stays a text column."""
    if "session_id" in df.columns:
        sessions = df.withColumn("session_id", F.col("session_id").cast("string"))
        sessions.withColumn("slot", slot(F.col("session_id"))).write.mode("append").partitionBy("slot").parquet(_path(base, table))
    else:
        df.write.mode("append").parquet(_path(base, table))


def exists(spark: SparkSession, base: str, table: str) -> bool:
    return path_exists(spark, _path(base, table))


def read(spark: SparkSession, base: str, table: str, session: str | None = None) -> DataFrame:
    """A table, or one session of it, read from its one folder."""
    df = spark.read.option("mergeSchema", table in ("model_registry", "data_profiles")).parquet(_path(base, table))  # older rows lack the later columns
    if session is not None:
        df = df.where((F.col("slot") == slot(F.lit(session))) & (F.col("session_id") == session))
    return df.drop("slot")


def append_history(df: DataFrame, base: str) -> None:
    """Rows: session_id, created_at, analysis_type, query, result (JSON text)."""
    append(df, base, "analysis_history")


def history(spark: SparkSession, base: str, session: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first; one session, or the newest ``limit`` of every session."""
    h = read(spark, base, "analysis_history", session)
    if session is not None:
        return h.orderBy(F.col("created_at").desc()).limit(int(limit))
    return top_k_per_group(h, ["session_id"], [F.col("created_at").desc(), F.col("entry_id")], int(limit),
                           salt_on=F.xxhash64("entry_id")).drop("rank")


def append_chat(df: DataFrame, base: str) -> None:
    """Rows: session_id, created_at, role (user / assistant / system), content."""
    bad = df.where(~F.col("role").isin(*CHAT_ROLES)).limit(1).count()
    if bad:
        raise ValueError(f"role must be one of {CHAT_ROLES}")
    append(df, base, "chat_history")


def chat(spark: SparkSession, base: str, session: str | None = None, limit: int = 100) -> DataFrame:
    """Oldest first; one session, or the first ``limit`` of every session. What
    was said up to a session's last clearing is hidden."""
    c = _uncleared(spark, base, read(spark, base, "chat_history", session))
    if session is not None:
        return c.orderBy("created_at").limit(int(limit))
    return top_k_per_group(c, ["session_id"], [F.col("created_at"), F.col("entry_id")], int(limit),
                           salt_on=F.xxhash64("entry_id")).drop("rank")


def _uncleared(spark: SparkSession, base: str, chat_rows: DataFrame) -> DataFrame:
    if not exists(spark, base, "chat_cleared"):
        return chat_rows
    last = read(spark, base, "chat_cleared").groupBy(F.col("session_id").alias("_session")).agg(F.max("cleared_to").alias("_to"))
    kept = chat_rows.join(last, F.col("session_id") == F.col("_session"), "left")
    return kept.where(F.col("_to").isNull() | (F.col("created_at") > F.col("_to"))).drop("_session", "_to")


def clear_chats(spark: SparkSession, base: str, sessions: DataFrame) -> None:
    """Delete the chats of ``sessions`` (session_id) as they are now: a line per session in the table of clearings
    says up to when, and reading joins it. No file of the chat table is touched, whatever its size; what a session
    says later is kept. ``compact_chat`` drops the hidden rows for good."""
    ids = sessions.select(F.col("session_id").cast("string").alias("_session")).distinct()
    now = read(spark, base, "chat_history").join(ids, F.col("session_id") == F.col("_session"), "left_semi")
    append(now.groupBy("session_id").agg(F.max("created_at").alias("cleared_to")), base, "chat_cleared")


def clear_chat(spark: SparkSession, base: str, session: str) -> None:
    """``clear_chats`` of one session."""
    clear_chats(spark, base, spark.createDataFrame([(session,)], "session_id string"))


def compact_chat(spark: SparkSession, base: str, new_base: str) -> str:
    """Write the chat table without its cleared rows to ``new_base`` (readers switch to it); the new base."""
    append(_uncleared(spark, base, read(spark, base, "chat_history")), new_base, "chat_history")
    return new_base


def register_models(spark: SparkSession, base: str, models: DataFrame) -> DataFrame:
    """models: (name, model_type, created_at, metrics, ...). Each gets version =
    current max(version) for its name + its order within the batch; appended
    and returned."""
    from pyspark.sql import Window
    if exists(spark, base, "model_registry"):
        cur = read(spark, base, "model_registry").groupBy("name").agg(F.max("version").alias("_v"))
    else:  # first registration
        cur = spark.createDataFrame([], "name string, _v long")
    w = Window.partitionBy("name").orderBy("created_at", "model_type")
    new = (models.join(cur, "name", "left")
           .withColumn("version", (F.coalesce(F.col("_v"), F.lit(0)) + F.row_number().over(w)).cast("long"))
           .drop("_v"))
    append(new, base, "model_registry")
    return new


def list_models(spark: SparkSession, base: str, model_type: str | None = None, limit: int = 20) -> DataFrame:
    m = read(spark, base, "model_registry")
    if model_type:
        m = m.where(F.col("model_type") == model_type)
    return m.orderBy(F.col("created_at").desc(), F.col("name"), F.col("version").desc()).limit(int(limit))


def save_profile(profile_rows: DataFrame, base: str, dataset: str, data: DataFrame | None = None) -> None:
    """Store a profile frame as JSON text rows with its data set name and, given the data, their quality score and
    their numbers of rows and columns."""
    rows = profile_rows.select(F.lit(dataset).alias("dataset"), F.current_timestamp().alias("created_at"),
                               F.to_json(F.struct(*profile_rows.columns)).alias("profile_json"))
    if data is not None:
        from tessera.operators.profile import quality_score
        facts = quality_score(data).select("quality_score").crossJoin(data.agg(F.count(F.lit(1)).alias("total_rows")))
        rows = rows.crossJoin(F.broadcast(facts)).withColumn("total_columns", F.lit(len(data.columns)).cast("long"))  # one row
    append(rows, base, "data_profiles")


def history_stats(spark: SparkSession, base: str) -> DataFrame:
    """Row counts of every history table present."""
    out = None
    for t in ("analysis_history", "chat_history", "model_registry", "data_profiles"):
        if exists(spark, base, t):
            part = read(spark, base, t).agg(F.count(F.lit(1)).cast("long").alias("rows"))
        else:
            part = spark.createDataFrame([(0,)], "rows long")
        part = part.select(F.lit(t).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
