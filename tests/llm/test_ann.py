import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v], 0) for i, v in zip(ids, x)], SCHEMA)


def brute(ids, x, every=50, k=5):
    out = {}
    x = np.asarray(x, np.float32).astype(np.float64)
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))
            order = sorted((-c, j) for c, j in zip(s, ids) if j != i)[:k]
            out[i] = [(j, -c) for c, j in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def clustered(n, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    return np.arange(n), rng.standard_normal((30, dims))[rng.integers(0, 30, n)] + .7 * rng.standard_normal((n, dims))


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 800)  # as if the table were much larger than the sample
    monkeypatch.setattr(ann, "SEEDS", 50)
    monkeypatch.setattr(ann, "BLOCK", 300)
    ids, x = clustered(6_000)
    found, true = got(ann.neighbours(frame(spark, ids, x))), brute(ids, x)
    assert found.keys() == true.keys() and all(len(v) == 5 for v in found.values())
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in true[q]}) for q in true)
    assert hits >= .95 * 5 * len(true)
    exact = {q: dict(v) for q, v in brute(ids, x, k=len(ids)).items()}
    assert all(s == pytest.approx(exact[q][j], abs=1e-12) for q, v in found.items() for j, s in v)


def test_scan_abandons_early_and_keeps_the_near():
    ids, x = clustered(2_000, 64)
    q = x[:20] + 1e-3
    rotation = ann.Index.fit(ids, x).rotation
    exact = ann.unit(q) @ ann.unit(x).T
    limits = 2 - 2 * np.sort(exact, axis=1)[:, -6]
    row, found, score, read = ann.scan(ids, x, np.full(20, -1), q, limits, rotation, 5)
    assert read < .8 * 20 * 2_000 * 64
    hits = sum(len(set(found[row == i]) & set(np.argsort(-exact[i])[:5])) for i in range(20))
    assert hits >= 97


def test_thresholds_tighten_to_the_kth_best():
    best, limits = np.full((3, 2), -np.inf), np.array([np.inf, 0.5, 0.1])
    best, limits = ann.tightened(best, limits, np.array([0, 1, 1, 2]), np.array([.9, .8, .6, .2]))
    assert limits == pytest.approx([np.inf, .5, .1]) and best[1] == pytest.approx([.6, .8])
    best, limits = ann.tightened(best, limits, np.array([0, 0, 1]), np.array([.95, .3, .9]))
    assert limits == pytest.approx([.2, .4, .1]) and best[0] == pytest.approx([.9, .95])


def test_equal_vectors_tie_to_the_smaller_id(spark):
    ids, x = clustered(400)
    x[100:300] = x[100]
    found = got(ann.neighbours(frame(spark, ids, x)))
    assert [j for j, _ in found[100]] == [101, 102, 103, 104, 105] and [j for j, _ in found[150]] == [100, 101, 102, 103, 104]


def test_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (50, [1.0, 1.0], 0), (1, [0.0, 2.0], 0), (1, [0.0, 2.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0),
            (6, [float("inf"), 1.0], 0), (None, [1.0, 2.0], 0), (7, [1.0], 0), (8, [], 0), (100, [0.0, 0.0], 0), (9, [1e-40, 3e38], None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("list", "vec", "part", "score", "rank")))
    found = got(ann.neighbours(df))
    assert {q: [j for j, _ in v] for q, v in found.items()} == {0: [50, 9, 1], 50: [0, 1, 9]}
    assert dict(found[0])[50] == pytest.approx(.5 ** .5) and dict(found[50])[9] == pytest.approx(.5 ** .5)
    assert ann.neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann.neighbours(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).collect() == []


@pytest.mark.parametrize("seeds", [ann.SEEDS, 3])
def test_repeated_rows_take_no_places(spark, monkeypatch, seeds):
    monkeypatch.setattr(ann, "SEEDS", seeds)
    ids, x = clustered(300)
    x[7], x[8] = x[0] + .001, x[50] + .001
    again = np.concatenate([ids, [7] * 12, [8] * 12, [0] * 3])
    found, true = got(ann.neighbours(frame(spark, again, x[again]), probes=1)), brute(ids, x)
    assert {q: [j for j, _ in v] for q, v in found.items()} == {q: [j for j, _ in v] for q, v in true.items()}
    other = [(7, [9.0] * 32, 0), (7, [-9.0] * 32, 0)]  # of different vectors the least one counts
    x[7] = -9.0
    df = frame(spark, ids[ids != 7], x[ids != 7]).union(spark.createDataFrame(other, SCHEMA))
    assert {q: [j for j, _ in v] for q, v in got(ann.neighbours(df, probes=1)).items()} == {q: [j for j, _ in v] for q, v in brute(ids, x).items()}


def test_squares_out_of_range():
    x, y = np.array([[1e200, 1e200], [1e-200, 0]]), np.array([[1e200, 0], [1e-200, 1e-200]])
    assert ann.cosines(x, y) == pytest.approx([.5 ** .5, .5 ** .5])


def test_registered_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    from tessera.llm.queries import QUERIES
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    true = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    found = got(QUERIES["op4_ann"](spark, sf))
    assert sum(len({j for j, _ in found[q]} & {j for j, _ in true[q]}) for q in true) >= .9 * sum(map(len, true.values()))
