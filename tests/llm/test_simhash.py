import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tests.llm import cases


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [words[i: i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    fps = [slow_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    first = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            first[g] = min(first.get(g, r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", first.get(g)) for r, f, g in zip(rows, fps, group)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def near_texts(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(150)] for _ in range(6)]
    out = []
    for i in range(n):
        text = rng.choice(bases)[:]
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(150)] = rng.choice(words)
        out.append((i, " ".join(text), "en", "s", 1))
    return out


def test_awkward_rows(spark):
    assert got(simhash.near_duplicates(cases.docs(spark))) == brute(cases.ROWS)
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []


def test_components_against_all_pairs(spark):
    rows = near_texts(150)
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < 140
    assert got(simhash.near_duplicates(cases.docs(spark, rows))) == expected


@pytest.mark.parametrize("blocks,tile", [(10, 16_384), (1 << 27, 16_384), (1 << 33, 3), (10, 2)])
def test_links_for_every_choice_of_tables_and_tiles(spark, blocks, tile):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 4, dtype=np.uint64)[rng.integers(0, 4, 80)]
    for _ in range(5):
        fps ^= np.where(rng.random(80) < .5, np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64), np.uint64(0))
    fps = np.unique(fps)
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    expected = {frozenset(int(fps[i].view(np.int64)) for i in range(len(fps)) if root[i] == r) for r in set(root)}
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, 4, tile, blocks)).collect()}
    groups = {}
    for x in fps:
        x = int(x.view(np.int64))
        groups.setdefault(found.get(x, x), set()).add(x)
    assert {frozenset(g) for g in groups.values()} == expected


@pytest.mark.parametrize("radius", range(8))
def test_sliced_counters(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 2, 63, 64, 65, 200):
        fps = rng.integers(0, 1 << 63, 3, dtype=np.uint64)[rng.integers(0, 3, n)]
        for _ in range(6):
            fps ^= np.where(rng.random(n) < .6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        starts = np.array([0, n // 3, n]) if n > 3 else np.array([0, n])
        found = {(int(i), int(j)) for a, b in simhash.sliced_links(fps, starts, radius) for i, j in zip(a, b)}
        assert found == {(i, j) for s, e in zip(starts, starts[1:]) for i in range(s, e) for j in range(i + 1, e)
                         if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    random.Random(1).shuffle(chain)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}


def test_keep_first(spark):
    kept = simhash.keep_first(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    marks = brute(cases.ROWS)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _, c in marks if i is not None and i == c})


def test_keep_first_decides_for_each_group(spark):
    """Null ids and repeated ids: every group keeps one document, whatever ids its rows share."""
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "ant bee cow dog elk".split()]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (9, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[4])]
    kept = simhash.keep_first(cases.docs(spark, [(*r, "en", "s", 1) for r in rows]))
    fps = [slow_fingerprint(t) for t in texts]
    assert min((a ^ b).bit_count() for a in fps for b in fps if a != b) > 4
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(None, texts[0]), (None, texts[1]), (9, texts[2]), (7, texts[3]), (7, texts[4])], key=str)
