"""The pipeline against its stages in plain Python, each with the brute-force version of its operator."""
import numpy as np
import public_tokenizers
import tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import cases, test_langid, test_linededup, test_mixing, test_simhash


def plain(rows):
    rows = [r for r, p in zip(sorted(rows, key=lambda r: str(r[0])), test_langid.slow_predict(rows)) if p[2] != "und" and p[3] >= .05]
    gone, out = test_linededup.brute(rows), []
    for doc_id, text, lang, source, n in rows:
        if doc_id in gone:
            drop = {*gone[doc_id][0], *gone[doc_id][1]}
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            n = len(text)
            if not text.split():
                continue
        out.append((doc_id, text, lang, source, n))
    keep = {i for i, _, c in test_simhash.brute(out) if i == c}
    out = [r for r in out if r[0] in keep]
    copies = {r[0]: r[4] // r[2] if r[2] else 0 for r in test_mixing.brute(out)}
    return [r for r in out for _ in range(copies[r[0]])]


def test_run_against_plain_python(spark, sf):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = sorted((r[0], library.encode(r[1], add_special_tokens=False).ids) for r in plain(rows))
    found = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, sf).collect())
    assert found == expected and 0 < len({i for i, _ in found}) < len(rows)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes


def test_awkward_and_empty_tables(spark):
    for docs in (cases.docs(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            assert docs.collect() is not None


def test_registered():
    names = [k for k in entry.queries() if k.startswith("op") and k[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
