"""Exact kNN / LOF against brute force on small fixtures; isolation forest
flag rate."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import anomaly, knn


def _brute_kdist(pts, k):
    out = []
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(axis=1))
        d = np.delete(d, i)
        out.append(np.sort(d)[k - 1])
    return np.array(out)


def test_knn_search_exact(spark):
    rng = np.random.default_rng(2)
    pts = np.round(rng.normal(size=(700, 2)) * [3, 1], 2)
    pts[:30] = pts[0]  # a hot duplicate point
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    vec = F.array("x", "y")
    dp = knn.distinct_points(df.select(vec.alias("vec")), "vec")
    nn = knn.knn_search(dp.select(F.col("pid").alias("qid"), "vec"), dp, 5, 2, exclude_self=True, cell_size=16)
    kd = {tuple(r["vec"]): r["kd"] for r in nn.groupBy("qid").agg(F.max("dist").alias("kd"))
          .join(dp.select(F.col("pid").alias("qid"), "vec"), "qid").collect()}
    want = _brute_kdist(pts, 5)
    for p, w in zip(pts, want):
        assert kd[(float(p[0]), float(p[1]))] == pytest.approx(w, abs=1e-9)


def _brute_lof(pts, k):
    n = len(pts)
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    idx = np.argsort(d, axis=1, kind="stable")[:, :k]
    kdist = d[np.arange(n)[:, None], idx][:, -1]
    reach = np.maximum(kdist[idx], d[np.arange(n)[:, None], idx])
    lrd = 1.0 / (reach.mean(axis=1) + 1e-10)
    return lrd[idx].mean(axis=1) / lrd


def test_lof_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = np.round(rng.normal(size=(300, 2)), 3)
    pts[:5] += 6
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    got = {r["id"]: r["lof"] for r in knn.lof_scores(df, ["x", "y"], k=10).collect()}
    want = _brute_lof(pts, 10)
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w, rel=1e-9)


def test_isolation_forest_flags_contamination(spark):
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(2000, 2))
    pts[:20] += 8
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    summary, flagged = anomaly.detect(df, ["x", "y"], "isolation_forest", 0.05)
    s = summary.first()
    assert s["anomaly_count"] == 100
    ids = {r["id"] for r in flagged.where("is_anomaly").collect()}
    assert len(ids & set(range(20))) >= 18


def test_knn_with_many_equal_projections(spark):
    """Hundreds of points share a projection, then a wide gap: the nearest are on the other points' side."""
    from tessera.operators.knn import distinct_points, knn_search
    from pyspark.sql import functions as F
    pts = [(0.0, float(y)) for y in range(-300, 301)] + [(1.0, 0.0)] + [(10_000.0 + 10 * i, 0.0) for i in range(2000)]
    df = spark.createDataFrame([(list(p),) for p in pts], "vec array<double>")
    refs = distinct_points(df, "vec")
    queries = spark.createDataFrame([([1.0, 0.0],), ([0.0, 250.0],)], "vec array<double>").withColumn("qid", F.col("vec"))
    out = knn_search(queries.select("qid", "vec"), refs, 5, 2, exclude_self=True).collect()
    near = sorted(r["dist"] for r in out if r["qid"] == [1.0, 0.0])
    assert near == pytest.approx([1.0, 2 ** 0.5, 2 ** 0.5, 5 ** 0.5, 5 ** 0.5])
    assert sorted(r["dist"] for r in out if r["qid"] == [0.0, 250.0]) == pytest.approx([1.0, 1.0, 2.0, 2.0, 3.0])


def test_forest_sample_is_never_empty():
    from tessera.operators.anomaly import sample_bound
    for n in (10 ** 6, 10 ** 9, 10 ** 12, 10 ** 15):
        expected = n * (sample_bound(4 * 256 / n) + 1) / 2 ** 63
        assert expected == pytest.approx(1024, rel=0.01)


def test_copies_join_a_tree_independently(spark):
    """A third of the rows is one row, the rest 49 kinds: every tree draws its full sample, with a third of the hot row."""
    n = 15_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") % 49 + 1.0).alias("x"))
    nodes = anomaly.build_forest(df, ["x"]).toPandas()
    assert nodes.loc[nodes["node"] == 0, "size"].tolist() == [256] * anomaly.N_TREES
    left = nodes[nodes["leaf"] & nodes["size"].between(55, 120)].groupby("tree").size()  # copies of the hot row end in one leaf
    assert len(left) >= 95
    scores = {r["x"]: r["score"] for r in anomaly.isolation_scores(df, ["x"]).distinct().collect()}
    assert len(scores) == 50


def test_occurrences_number_every_copy(spark):
    from tessera.functions.longform import occurrences
    df = spark.createDataFrame([("a", 1), ("b", 7), (None, 8), ("c", 3000)], "k string, n long")
    got = occurrences(df, ["k"], "n", 4).groupBy("k").agg(F.sort_array(F.collect_list("_occ")).alias("o")).collect()
    assert {r["k"]: r["o"] for r in got} == {"a": [0], "b": list(range(7)), None: list(range(8)), "c": list(range(3000))}


def test_shapiro_sample_draws_copies_independently(spark):
    from tessera.operators.stats import shapiro
    df = spark.range(4000).select((F.col("id") % 20).cast("double").alias("x"))
    row = shapiro(df, ["x"], max_n=100).first()
    assert row["n"] == 100 and .9 < row["statistic"] < .99  # all 200 copies of one value gave no statistic


def _brute_weighted(queries, pts, w, k, exclude):
    """(query, point) -> copies among the k nearest, by distance and then point."""
    out = {}
    for q in queries:
        d = np.zeros(len(pts))
        for i in range(pts.shape[1]):
            d += (pts[:, i] - q[i]) ** 2
        left = k
        for j in sorted(range(len(pts)), key=lambda j: (np.sqrt(d[j]), tuple(pts[j]))):
            n = min(left, w[j] - (exclude and tuple(pts[j]) == tuple(q)))
            if n > 0:
                out[tuple(q), tuple(pts[j])] = n
                left -= n
    return out


def _fixture(kind):
    rng = np.random.default_rng(5)
    if kind == "grid":
        return np.array([(x, y) for x in range(30) for y in range(20)], float)
    if kind == "clustered":
        centres = rng.uniform(-1000, 1000, (6, 3))
        return np.round(np.concatenate([rng.normal(c, 0.5, (120, 3)) for c in centres] + [rng.uniform(-1000, 1000, (30, 3))]), 2)
    if kind == "line":
        return np.stack([np.repeat(np.arange(50.0), 8), np.zeros(400), np.tile(np.arange(8.0), 50) * 1e-7], axis=1)
    return rng.normal(size=(400, 10))


@pytest.mark.parametrize("kind", ["grid", "clustered", "line", "ten"])
@pytest.mark.parametrize("exclude", [True, False])
def test_metric_partition_equals_brute_force(spark, kind, exclude, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 40)
    monkeypatch.setattr(knn, "CHUNK", 30)
    pts = np.unique(_fixture(kind), axis=0)
    w = [1 + i % 3 for i in range(len(pts))]
    refs = spark.createDataFrame([(p.tolist(), p.tolist(), n) for p, n in zip(pts, w)], "pid array<double>, vec array<double>, w long")
    queries = refs.select(F.col("pid").alias("qid"), "vec").where(F.pmod(F.xxhash64("pid"), F.lit(4)) == 0) if exclude else \
        spark.createDataFrame([((p + 0.25).tolist(),) * 2 for p in pts[::5]], "qid array<double>, vec array<double>")
    asked = np.array([r["qid"] for r in queries.collect()])
    rows = knn.knn_search(queries, refs, 4, pts.shape[1], exclude_self=exclude, cell_size=25).collect()
    assert {(tuple(r["qid"]), tuple(r["pid"])): r["c"] for r in rows} == _brute_weighted(asked, pts, w, 4, exclude)


def test_few_rows_leave_a_block():
    rng = np.random.default_rng(8)
    q, r = rng.normal(size=(50, 3)), rng.normal(size=(3_000, 3))
    pivot = np.zeros(3)
    away = lambda x: np.sqrt(((x - pivot) ** 2).sum(axis=1))
    i, j, d = knn.block_best(q, away(q), np.full(50, np.inf), r, away(r), np.ones(3_000, np.int64), 7)
    assert np.bincount(i).tolist() == [7] * 50
    assert all(np.allclose(d[i == x], np.sort(np.sqrt(((r - q[x]) ** 2).sum(axis=1)))[:7]) for x in range(50))


def test_no_references_or_too_few(spark):
    empty = spark.createDataFrame([], "pid array<double>, vec array<double>, w long")
    queries = spark.createDataFrame([([1.0], [1.0])], "qid array<double>, vec array<double>")
    assert knn.knn_search(queries, empty, 3, 1).collect() == []
    few = spark.createDataFrame([([1.0], [1.0], 1), ([9.0], [9.0], 1)], empty.schema)
    assert [(r["pid"], r["c"]) for r in knn.knn_search(queries, few, 5, 1).orderBy("dist").collect()] == [([1.0], 1), ([9.0], 1)]
    assert knn.knn_search(queries.limit(0), few, 5, 1).collect() == []
    from pyspark.ml.linalg import Vectors
    rows = spark.createDataFrame([(1.0, Vectors.dense([1.0]))], ["label", "features"])
    assert knn.knn_classify(rows.limit(0), rows).collect() == []


def test_cells_stay_small_whatever_the_number_of_points():
    """With 10 000 cells' worth of points no cell is larger than meant, and a walk finds the boxes that a full scan finds."""
    rng = np.random.default_rng(9)
    pts = np.unique(np.round(np.stack([rng.exponential(50, 40_000), rng.integers(0, 3_000, 40_000)], axis=1), 2), axis=0)
    cells = knn.Cells(pts, 10_000)
    own = cells.place(pts)
    size = np.bincount(own, minlength=len(cells.count))
    assert 1 <= size.min() and size.max() <= 4 and len(size) >= 10_000
    low, high = (f.reduceat(pts[np.argsort(own, kind="stable")], np.cumsum(size) - size) for f in (np.minimum, np.maximum))
    cells.hold(zip(range(len(size)), size, size, low, high), 21)
    asked = rng.choice(len(pts), 200, replace=False)
    bound = cells.first_bound(pts[asked], own[asked])
    away = np.sqrt(((pts[asked][:, None] - pts[None]) ** 2).sum(axis=2))
    assert ((away <= bound[:, None]).sum(axis=1) >= 21).all() and np.median(bound) < 50
    found = {(int(r), int(c)) for rows, some in cells.within_reach(pts[asked], bound) for r, c in zip(rows, some)}
    assert {(i, int(own[j])) for i, j in zip(*np.nonzero(away <= bound[:, None]))} <= found
    gap = np.maximum(np.maximum(low[None] - pts[asked][:, None], pts[asked][:, None] - high[None]), 0)
    assert found == {(int(i), int(c)) for i, c in zip(*np.nonzero(np.sqrt((gap ** 2).sum(axis=2)) <= bound[:, None] * (1 + 1e-9) + 1e-9))}


def test_incomplete_points_hide_no_neighbours(spark):
    """A point without one component has no place: it is nobody's neighbour, finds none, and leaves those of others as they are."""
    pts = [[float(x), float(y)] for x in range(20) for y in range(10)]
    schema = "pid array<double>, vec array<double>, w long"
    whole = spark.createDataFrame([(p, p, 1) for p in pts], schema)
    some = whole.unionByName(spark.createDataFrame([(p, p, 1) for p in ([None, 3.0], [4.0, None])], schema))
    near = lambda refs: {(*r["qid"], *r["pid"]) for r in knn.knn_search(
        refs.select(F.col("pid").alias("qid"), "vec"), refs, 3, 2, exclude_self=True, cell_size=16).collect()}
    assert near(some) == near(whole) and len(near(whole)) == 600
