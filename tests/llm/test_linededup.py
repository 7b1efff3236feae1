import random

import numpy as np

from tessera.llm import linededup
from tests.llm import cases


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, least=linededup.MIN_WORDS):
    """Per doc_id the exact and near duplicate line numbers, from all pairs of lines."""
    every = []
    for doc_id, text, *_ in rows:
        for no, line in enumerate((text or "").split("\n")):
            if words := line.encode().lower().split():
                every.append(((doc_id is not None, doc_id or 0, no), doc_id, tuple(words)))
    first = {}
    for place, _, words in every:
        first[words] = min(first.get(words, place), place)
    close = {a: any(abs(len(a) - len(b)) <= 1 and min(len(a), len(b)) >= least and first[b] < first[a] and edits(a, b) == 1 for b in first)
             for a in first if len(a) >= least}
    out = {}
    for place, doc_id, words in every:
        found = out.setdefault(doc_id, (set(), set()))
        if place != first[words]:
            found[0].add(place[2])
        elif close.get(words):
            found[1].add(place[2])
    return {k: (sorted(a), sorted(b)) for k, (a, b) in out.items() if a or b}


def found(df):
    return {r.doc_id: (r.exact, r.near) for r in df.collect()}


def test_awkward_rows(spark):
    assert found(linededup.duplicate_lines(cases.docs(spark))) == brute(cases.ROWS)
    assert linededup.duplicate_lines(cases.empty(spark)).collect() == []
    report = linededup.line_report(cases.docs(spark)).collect()
    assert len(report) == len(cases.ROWS) and {r.n_lines for r in report if r.doc_id == 3} == {0}
    assert linededup.line_report(cases.empty(spark)).collect() == []


def test_against_all_pairs(spark):
    rng = random.Random(5)
    pool = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(9, 14))] for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool)[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, what = rng.randrange(len(line)), rng.randrange(3)
                line[at: at + (what != 0)] = [rng.choice("abcdefgh") * 2] if what != 2 else []
            lines.append(rng.choice(["", " ", ""]) + " ".join(line).upper() if rng.random() < .2 else " ".join(line))
        rows.append((i, "\n".join(lines), "en", "s", 1))
    expected = brute(rows)
    assert sum(len(near) for _, near in expected.values()) > 10
    assert found(linededup.duplicate_lines(cases.docs(spark, rows))) == expected


def test_neighbourhood_is_what_deleting_gives():
    powers, words = linededup.Powers(), b"a b b c d e".split()
    u, v, place = linededup.neighbourhood(b" ".join(words), powers)
    assert place.tolist() == [-1, *range(6)] and (u[2], v[2]) == (u[3], v[3]) and len(set(zip(u, v))) == 6
    for i in range(6):
        x, y, _ = linededup.neighbourhood(b" ".join(words[:i] + words[i + 1:]), powers)
        assert (x[0], y[0]) == (u[i + 1], v[i + 1])


def test_one_edit():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice([b"x", b"y"]) for _ in range(rng.randint(1, 5))] for _ in "ab")
        assert linededup.one_edit(b" ".join(a), b" ".join(b)) == (edits(a, b) <= 1)


def test_halves_meet_for_every_single_edit():
    rng = random.Random(7)

    def keys(words):
        k = linededup._halves(words)
        return set(k[:2]), set(k)

    for n in range(2, 12):
        a = [str(rng.random()).encode() for _ in range(n)]
        for i in range(n + 1):
            longer = a[:i] + [b"new"] + a[i:]
            assert keys(a)[0] & keys(longer)[1]
            if i < n:
                assert keys(a)[0] & keys(a[:i] + [b"new"] + a[i + 1:])[0]


def test_stage_rewrites_texts(spark):
    twelve = " ".join("one two three four five six seven eight nine ten eleven twelve".split())
    rows = [(1, f"{twelve}\n\nown line", "en", "a", 1), (2, f"{twelve}\nother line\n{twelve.replace('six', '6')}", "en", "a", 1),
            (3, twelve.upper(), "en", "a", 1), (4, "", None, None, 0), (5, None, None, None, None)]
    out = linededup.without_duplicate_lines(cases.docs(spark, rows))
    assert out.columns == cases.docs(spark).columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.doc_id < 5) == [
        (1, rows[0][1], 1), (2, "other line", 10), (4, "", 0)]
    assert {r.doc_id for r in out.collect()} == {1, 2, 4, 5}


def test_rows_that_share_an_id(spark):
    """Null ids and repeated ids with other texts: each text has its own answer, as if it had its own id."""
    alone = [f"{w} one two three four five six seven eight nine" for w in ("ant", "bee", "cow", "dog")]
    near = alone[0].replace("five", "5")
    texts = ["copied", "copied\nbee", "cow", "dog\ncopied\nemu", alone[0], f"fox\n{near}", f"{near.upper()}\ngnu", alone[1].replace("one", "1 1 1")]
    for ids in ([None] * len(texts), [5] * len(texts), [None, 5] * (len(texts) // 2)):
        rows = list(zip(ids, texts, ["en"] * len(texts), ["s"] * len(texts), [1] * len(texts)))
        df = cases.docs(spark, rows)
        marks = {r.text: r.mark for r in df.select("text", linededup.text_mark("text").alias("mark")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1]]))
        expected = brute([(i, r[1]) for i, r in enumerate(order)])
        answers = [expected.get(i, ([], [])) for i in range(len(order))]
        report = linededup.line_report(df).collect()
        n = [len(r[1].split("\n")) for r in order]
        assert sorted(((r.doc_id, r.n_lines, r.exact, r.near, r.n_kept) for r in report), key=str) == sorted(
            ((r[0], m, a, b, m - len(a) - len(b)) for r, m, (a, b) in zip(order, n, answers)), key=str)
        left = ["\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in a + b) for r, (a, b) in zip(order, answers)]
        assert sorted(r.text for r in linededup.without_duplicate_lines(df).collect()) == sorted(x for x in left if x)
        assert sum(len(a) for a, _ in answers) >= 3 and any(b for _, b in answers)
