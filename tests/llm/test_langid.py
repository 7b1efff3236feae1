from collections import Counter

import pytest

from tessera.llm import langid
from tests.llm import cases


def slow_grams(text):
    padded = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    padded = " " + " ".join(padded.split()) + " "
    found = [padded[i: i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
    return [g for g in found if g.strip()] if padded.strip() else []


def slow_profile(grams, size=langid.PROFILE):
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(Counter(grams), key=lambda g, n=Counter(grams): (-n[g], code(g)))[:size]


def slow_predict(rows):
    by = {}
    for doc_id, text, lang, *_ in rows:
        if text is not None and lang is not None and not (doc_id is not None and langid.crc_held_out(doc_id)):
            by.setdefault(lang, []).extend(slow_grams(text))
    profiles = {k: {g: i for i, g in enumerate(slow_profile(v))} for k, v in by.items() if v}
    out = []
    for doc_id, text, *_ in rows:
        own = slow_profile(slow_grams(text))
        held = doc_id is not None and langid.crc_held_out(doc_id)
        if not own or not profiles:
            out.append((doc_id, held, "und", 0.0))
            continue
        far = {k: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out.append((doc_id, held, best, 1 - far[best] / (langid.PROFILE * len(own))))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    assert sorted(map(tuple, langid.predict(cases.docs(spark)).collect()), key=str) == slow_predict(cases.ROWS)
    assert langid.predict(cases.empty(spark)).collect() == []


def test_nothing_to_learn_from(spark):
    rows = [(1, "some words", None, "a", 1), (2, None, "en", "a", 1)]
    assert {r.lang_pred for r in langid.predict(cases.docs(spark, rows)).collect()} == {"und"}


def test_held_out_accuracy_and_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    found = sorted(map(tuple, langid.predict(docs).collect()), key=str)
    assert found == slow_predict(rows)
    lang = {r[0]: r[2] for r in rows}
    tested = [(lang[i], p) for i, held, p, _ in found if held]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)


@pytest.mark.parametrize("text,n", [("", 0), ("1 2", 0), ("ab", 2 + 3 + 2), ("a-b", 2 + 4 + 3)])
def test_grams(text, n):
    assert len(langid.grams(text)) == len(slow_grams(text)) == n


def test_stage_keeps_written_language(spark):
    kept = langid.keep_identified(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 2, 6, None, 8, 9, 10], key=str)


def test_a_corpus_without_labels_keeps_its_texts(spark):
    rows = [(i, t, None, "a", 1) for i, t in enumerate(["An English text", "Ein deutscher Text", "123 !!", None, ""])]
    assert sorted(r.doc_id for r in langid.keep_identified(cases.docs(spark, rows)).collect()) == [0, 1]
