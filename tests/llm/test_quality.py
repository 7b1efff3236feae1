import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from tessera.llm import quality
from tests.llm import cases


def slow(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    again, seen = 0, set()
    for line in text.split("\n"):
        if line.encode().split():
            again += line in seen
            seen.add(line)
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered))


def test_counts():
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join(rng.choice(["a", "b", "cé", "#", "<x>", "\n"]) for _ in range(rng.randint(0, 80)))
        assert quality.count(text.encode())[:5] == slow(text)
    assert quality.count(None)[:5] == (0, 0, 0, 0, 0)
    assert quality.count(b"AB c! \xc3\xa9!")[5:] == (1, 2, 3, 2)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, .1), (30, 4, .05), (200, 3, .01), (5, 5, .3)):
        q = Fraction(p)
        assert quality.binomial_tail(k, n, p) == pytest.approx(float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))), rel=1e-9)


def test_choose_stops_at_the_first_failure():
    assert quality.choose([0, 0, 1], 100, 1, .01, .05) == 0  # 0.99^100 is above 0.05: too few documents to prove anything
    assert quality.choose([0, 1, 50, 0], 1000, 1, .01, .05) == 2
    assert quality.choose([0], 0, 1) == 0


def test_risk_is_controlled():
    """Over many draws of labels the chosen step's true loss exceeds alpha about as rarely as promised."""
    rng, true = np.random.default_rng(0), np.array([.001, .004, .009, .02, .05])
    bad = 0
    for _ in range(400):
        hit = np.searchsorted(true, rng.random(1500))  # first step that rejects
        lost = [int((hit <= t).sum()) for t in range(5)]
        k = quality.choose(lost, 1500, 1, .01, .05)
        bad += k > 0 and true[k - 1] > .01
    assert bad <= 400 * .05 * 1.5


def test_proposed_cutoffs_only_get_stricter():
    good, bad = np.zeros(201, int), np.zeros(201, int)
    good[:3], good[60] = 1000, 1
    bad[50:90] = 5
    path = quality.propose(good, bad)
    assert path == sorted(path, reverse=True) and path[0] > 60 and path[-1] < 90
    assert quality.propose(good, np.zeros(201, int)) == [201] * quality.STEPS


def made(n, langs=("en", "de")):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) + str(rng.randrange(50)) for _ in range(60)]
        good = i % 4 > 0
        if not good:
            text = [w.upper() + "!!" for w in text] if i % 8 else [w + "***" for w in text]
        rows.append((i, " ".join(text), langs[i % len(langs)], "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


def brute(counted, labels, stratum):
    """kept by plain Python from the counts of each document."""
    levels = {}
    for r in counted:
        share = lambda a, b, s=200: min(200, int(a / b * s)) if b else 0
        mean = share(r.word_chars, r.n_words, 5)
        levels[r.doc_id] = [share(r.n_symbols, r.n_words), share(r.n_upper, r.n_letters), share(r.n_marks, r.n_words), share(r.n_dup_lines, r.n_lines),
                            share(r.n_repeat_words, r.n_words), mean, 200 - mean]
    return levels


def test_bad_documents_go_and_good_ones_stay(spark):
    rows, labels = made(6_000)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(cases.docs(spark, rows), marks).collect()}
    lost = sum(not out[i].kept for i, good, _ in labels if good)
    caught = sum(not out[i].kept for i, good, _ in labels if not good)
    assert len(out) == 6_000 and lost <= .01 * 4_500 and caught >= .9 * 1_500
    # the steps and levels by plain Python
    model = quality.calibrate(quality.signals(cases.docs(spark, rows), stratum_col="lang"), marks)
    levels = brute(out.values(), labels, None)
    for i, text, lang, *_ in rows:
        path, held = model[lang]
        step = min(next((t for t in range(quality.STEPS) if levels[i][r] >= path[r][t]), quality.STEPS) for r in range(7))
        assert out[i].step == step and out[i].kept == (step >= held)


def test_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (1, 1, 0), (None, 0, 0), (2, 0, 1), (2, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        out = quality.judge(cases.docs(spark), labels).collect()
        assert sorted(((r.doc_id, *r[1:6]) for r in out), key=str) == sorted(((r[0], *quality.count(r[1] and r[1].encode())[:5]) for r in cases.ROWS), key=str)
        assert all(r.kept != r.base_failed for r in out)
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
        assert quality.judge(cases.empty(spark), labels).collect() == []
