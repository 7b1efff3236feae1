import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm import mixing
from tests.llm import cases


def words(text):
    return len((text or "").encode().split())


def shared_out(sizes, weights=mixing.WEIGHTS, share=1.5):
    """Targets by rounds: what is over the caps goes to the rest by weight until nothing is over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > mixing.MOST * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: float(mixing.MOST * sizes[s]) for s in over}


def brute(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    targets, out, by, seen = shared_out(sizes), [], defaultdict(list), Counter()
    for doc_id, text, _, source, _ in rows:
        ratio = targets[source] / sizes[source] if sizes[source] else 0
        mark = hashlib.md5((text or "").encode()).hexdigest()
        occ = seen[doc_id, mark, source]
        seen[doc_id, mark, source] += 1
        u = (int(hashlib.md5(f"42:{'' if doc_id is None else doc_id}:{mark}:{occ}".encode()).hexdigest()[:13], 16) + .5) / 2**52
        f, n = ratio - math.floor(ratio + 1e-12), words(text)
        rank = u / (1 - u) / (f / (1 - f) * max(n, 1) ** -.25) if f > 1e-9 and n else math.inf
        by[source].append([rank, doc_id is not None, doc_id or 0, mark, occ, n, math.floor(ratio + 1e-12)])
    for source, docs in by.items():
        left, so_far = targets[source] - sum(d[6] * d[5] for d in docs), 0
        for rank, known, doc_id, _, _, n, whole in sorted(docs):
            more = rank < math.inf and so_far + n / 2 <= left + 1e-9
            so_far += n if rank < math.inf else 0
            out.append((doc_id if known else None, source, n, round(targets[source], 6), (whole + more) * n))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.source, r.size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    assert got(mixing.mix(cases.docs(spark))) == brute(cases.ROWS)
    assert mixing.mix(cases.empty(spark)).collect() == []
    assert mixing.mixed_documents(cases.empty(spark)).collect() == []


def test_only_wordless_texts(spark):
    rows = [(1, None, "en", "a", 1), (2, " ", "en", None, 1)]
    assert [(r.size, r.target, r.taken) for r in mixing.mix(cases.docs(spark, rows)).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_bins_do_not_matter(spark, sf, bins, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", bins)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(mixing.mix(docs)) == brute([tuple(r) for r in docs.collect()])


def test_targets_are_met_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 400)), "en", f"s{min(i % 12, 4)}", 1) for i in range(3_000)]
    first, again = mixing.mix(cases.docs(spark, rows)), mixing.mix(cases.docs(spark, rows[::-1]).repartition(7))
    assert got(first) == got(again)
    taken, target = defaultdict(int), {}
    for r in first.collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 200 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(words(r[1]) for r in rows)) < 1e-3


def test_water_filling_with_many_caps(spark):
    rows = [(i, " ".join(["w"] * n), "en", s, 1) for i, (s, n) in enumerate([("a", 1), ("b", 900), ("c", 5), ("d", 50), ("e", 4000), (None, 3), ("f", 0)])]
    expected = shared_out({r[3]: words(r[1]) for r in rows})
    found = {r.source: r.target for r in mixing.targets(mixing.sizes(cases.docs(spark, rows))).collect()}
    assert found == pytest.approx(expected)


def test_no_python_on_the_executors(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_documents_are_repeated_as_often_as_taken(spark):
    expected = defaultdict(int)
    for r in mixing.mix(cases.docs(spark)).collect():
        expected[r.doc_id] += r.copies
    found = defaultdict(int)
    out = mixing.mixed_documents(cases.docs(spark))
    assert out.columns == cases.docs(spark).columns
    for r in out.collect():
        found[r.doc_id] += 1
    assert found == {k: v for k, v in expected.items() if v}


def test_oracle(spark, sf):
    from tessera.llm.queries import QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.execute(mixing.SQL)
    names = [d[0] for d in expected.description]
    rows = QUERIES["op9_mixing"](spark, sf).select(*names).collect()
    assert sorted(((*r[:3], round(r[3], 6), *r[4:]) for r in rows)) == sorted((*r[:3], round(r[3], 6), *r[4:]) for r in expected.fetchall())


def test_copies_of_a_row_are_drawn_independently(spark):
    """Half the rows are one row, the others distinct: both get their share of second copies."""
    rows = [(1, "one two three four", "en", "a", 1)] * 3_000 + [(i, "one two three four", "en", "a", 1) for i in range(2, 3_002)] + \
        [(i, "w", "en", "b", 1) for i in range(9_000, 9_200)] + [(i, "one two three four", "en", "c", 1) for i in range(10_000, 12_000)]
    out = mixing.mix(cases.docs(spark, rows)).where("source = 'a'").collect()
    least = min(r.copies for r in out)
    more = lambda some: sum(r.copies - least for r in some) / len(some)
    same, others = [r for r in out if r.doc_id == 1], [r for r in out if r.doc_id != 1]
    assert len(same) == 3_000 and 0 < more(out) < 1 and abs(more(same) - more(others)) < .05
    found = mixing.mixed_documents(cases.docs(spark, rows).repartition(3)).where("source = 'a' AND doc_id = 1").count()
    assert found == sum(r.copies for r in same)


def test_equal_rows_with_other_columns_share_in_turn(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "a", i) for i in range(9)] + [(2, "a b c", "en", "b", 1)] * 3, cases.SCHEMA)
    copies = Counter(r.n_chars for r in mixing.mixed_documents(docs).where("doc_id = 1").collect())
    total = sum(r.copies for r in mixing.mix(docs).where("doc_id = 1").collect())
    assert sum(copies.values()) == total and max(copies.values()) - min([copies[i] for i in range(9)]) <= 1
