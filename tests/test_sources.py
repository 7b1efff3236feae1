"""Sources and sinks: CSV header cleaning / sniffing, JSON flattening,
history tables, streaming ingest."""
import glob
import os
import os

import pytest
from pyspark.sql import functions as F

from tessera.session import scratch_path
from tessera.sources import csv, history, json as js
from tessera.streaming import ingest


def test_read_csv_header_cleanup_and_errors(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿ a ; b \n1;x\n2;y\n".encode("utf-8"))
    df = csv.read_csv(spark, str(p))
    assert df.columns == ["a", "b"] and df.count() == 2
    with pytest.raises(FileNotFoundError):
        csv.read_csv(spark, str(tmp_path / "missing.csv"))
    q = tmp_path / "a.parquet"
    q.write_text("x")
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(q))


def test_sniffers(spark, tmp_path):
    (tmp_path / "l1.csv").write_bytes("a|b|c\n1|2|3\n".encode("utf-8"))
    (tmp_path / "l2.csv").write_bytes("name;city\nRen\xe9;Li\xe8ge\n".encode("latin-1"))
    enc = {os.path.basename(r["file_path"]): r["encoding"] for r in csv.csv_encodings(spark, str(tmp_path)).collect()}
    dl = {os.path.basename(r["file_path"]): r["delimiter"] for r in csv.csv_delimiters(spark, str(tmp_path)).collect()}
    assert enc == {"l1.csv": "utf-8", "l2.csv": "latin-1"}
    assert dl == {"l1.csv": "|", "l2.csv": ";"}
    df = csv.read_csv(spark, str(tmp_path / "l2.csv"))
    assert df.first()["name"] == "René"


def test_json_flatten_and_path(spark, tmp_path):
    p = tmp_path / "j.json"
    p.write_text('{"a": {"b": 1, "c": {"d": "x"}}, "arr": [1, 2]}\n{"a": {"b": 2}, "arr": []}\n')
    df = js.read_json(spark, str(p))
    assert sorted(df.columns) == ["a.b", "a.c.d", "arr"]
    sub = js.read_json(spark, str(p), "a")
    assert sorted(sub.columns) == ["b", "c.d"]
    with pytest.raises(KeyError):
        js.read_json(spark, str(p), "nope")
    t = spark.createDataFrame([(1, '{"k": 3, "m": {"n": true}}'), (2, 'not json')], "id long, j string")
    f = js.parse_json_col(t, "j")
    assert sorted(f.columns) == ["id", "j.k", "j.m.n"]
    assert {r["id"]: r["j.k"] for r in f.collect()} == {1: 3, 2: None}


def test_history_roundtrip(spark):
    base = scratch_path(spark, "test-history")
    rows = spark.createDataFrame([("s1", i, i, "user", f"q{i}") for i in range(5)] + [("s2", 0, 0, "system", "x")],
                                 "session_id string, entry_id long, created_at long, role string, content string")
    history.append_chat(rows, base)
    got = history.chat(spark, base, "s1", limit=3).collect()
    assert [r["entry_id"] for r in got] == [0, 1, 2]
    bad = spark.createDataFrame([("s3", 0, 0, "robot", "x")], rows.schema)
    with pytest.raises(ValueError):
        history.append_chat(bad, base)
    files = sorted((p, os.path.getmtime(p)) for p in glob.glob(f"{base}/chat_history/**", recursive=True))
    history.clear_chat(spark, base, "s1")
    assert files == sorted((p, os.path.getmtime(p)) for p in glob.glob(f"{base}/chat_history/**", recursive=True))
    assert history.chat(spark, base, "s1").collect() == [] and [r["content"] for r in history.chat(spark, base, "s2").collect()] == ["x"]
    history.append_chat(spark.createDataFrame([("s1", 9, 9, "user", "later")], rows.schema), base)
    assert [r["content"] for r in history.chat(spark, base, "s1").collect()] == ["later"]
    assert {r["session_id"] for r in history.chat(spark, base).collect()} == {"s1", "s2"}
    new_base = history.compact_chat(spark, base, scratch_path(spark, "test-history-v2"))
    assert {(r["session_id"], r["content"]) for r in history.read(spark, new_base, "chat_history").collect()} == {("s1", "later"), ("s2", "x")}


def test_model_registry_versions(spark):
    base = scratch_path(spark, "test-models")
    m = spark.createDataFrame([("a", "reg", 1, "{}"), ("a", "reg", 2, "{}"), ("b", "clf", 1, "{}")],
                              "name string, model_type string, created_at long, metrics string")
    history.register_models(spark, base, m)
    v = history.register_models(spark, base, m.where("name = 'b'"))
    assert v.first()["version"] == 2
    assert [r["name"] for r in history.list_models(spark, base, "reg").collect()] == ["a", "a"]


def test_streaming_ingest_exactly_once(spark):
    landing = scratch_path(spark, "test-landing")
    df = spark.createDataFrame([("s", i, "user", "t") for i in range(10)],
                               "session_id string, entry_id long, role string, content string")
    df.write.json(landing)
    table_path, ckpt = scratch_path(spark, "test-stream"), scratch_path(spark, "test-stream-ckpt")
    schema = "session_id string, entry_id long, role string, content string"
    assert ingest.ingest_now(spark, landing, schema, table_path, ckpt).count() == 10
    # a second run over the same files appends nothing
    assert ingest.ingest_now(spark, landing, schema, table_path, ckpt).count() == 10


def test_records_of_files_cut_into_many_splits(spark, tmp_path):
    import csv as std
    import random
    from tessera.sources import csv
    rng, expected = random.Random(4), {}
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n"), ("c.csv", "\n")):
        rows = [["id", "text"]] + [[str(i), rng.choice(["plain", 'a "quoted" word', "two\nlines", "", "\n\n", ',"', "x" * rng.randint(0, 90)])] for i in range(900)]
        with open(tmp_path / name, "w", newline="") as f:
            std.writer(f, lineterminator=end).writerows(rows)
        expected[name] = len(rows)
    with open(tmp_path / "c.csv", "a") as f:
        f.write('\n\n901,"never closed\nto the end')
    expected["c.csv"] += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200b", "1000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {os.path.basename(r["file_path"]): r["records"] for r in csv.csv_records(spark, str(tmp_path)).collect()}
            assert got == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_catalog_lists_types_and_nullability(spark):
    from pyspark.sql import types as T
    from tessera.sources import tables
    schema = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.StringType(), True)])
    tables.register_views(spark, {"t_catalog": spark.createDataFrame([(1, "a"), (2, None)], schema)})
    rows = [tuple(r) for r in tables.catalog_metadata(spark, ["t_catalog"]).orderBy("position").collect()]
    assert rows == [("t_catalog", 0, "k", "bigint", False, 2), ("t_catalog", 1, "v", "string", True, 2)]
    with pytest.raises(ValueError):
        tables.catalog_metadata(spark, ["no_such_table"])
