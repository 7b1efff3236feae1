import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tests.llm import cases


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i: i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def fold(tree, at, digest):
    """(digest at the root, siblings) of a leaf that shows ``digest``."""
    proof = ""
    for nodes in tree[:-1]:
        run, place = nodes[at // 16 * 16: at // 16 * 16 + 16], at % 16
        left, right = "".join(run[:place]), "".join(run[place + 1:])
        digest, proof, at = sha(left, digest, right), proof + left + right, at // 16
    return digest, proof


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        text = r[1]
        bent = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by[r[3]].append((r[0], leaf(*r), leaf(r[0], bent, *r[2:]) if tampered else leaf(*r)))
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(by[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, levels([x[1] for x in leaves])))
    top = levels([t[-1][0] for _, t in trees])
    out = []
    for place, (leaves, tree) in enumerate(trees):
        for at, (doc_id, own, shown) in enumerate(leaves):
            below, proof = fold(tree, at, shown)
            folded, rest = fold(top, place, below)
            out.append((doc_id, own, tree[-1][0], top[-1][0], sha(proof + rest), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_awkward_rows(spark):
    assert got(merkle.audit(cases.docs(spark))) == brute(cases.ROWS)
    assert merkle.audit(cases.empty(spark)).collect() == []
    one = cases.ROWS[:1]
    assert got(merkle.audit(cases.docs(spark, one))) == brute(one)
    # no siblings anywhere: the digest of nothing
    assert merkle.audit(cases.docs(spark, one)).first().proof_sha256 == sha("")


@pytest.mark.parametrize("n", [1, 15, 16, 17, 257])
def test_sizes_around_the_width(spark, n):
    rows = [(i, f"Text {i}", "en", "a" if i < n else f"s{i}", i) for i in range(n + 20)]
    assert got(merkle.audit(cases.docs(spark, rows).repartition(5))) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(7, "Same", "en", "a", 1)] * 300 + [(None, f"T{i % 9}", None, None, None) for i in range(40)]
    assert got(merkle.audit(cases.docs(spark, rows).repartition(6))) == brute(rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(merkle.audit(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])


def test_some_leaves_fetch_little(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", i) for i in range(3_000)]
    found = merkle.manifest(cases.docs(spark, rows))
    some = found.leaves.where("doc_id % 100 = 0").withColumn("shown", F.col("leaf"))
    expected = [r for r in brute(rows) if r[0] % 100 == 0]
    for span in (16, 4096):
        assert [(*r[:5],) for r in got(merkle.prove(found, some, span))] == [(*r[:5],) for r in expected]
    assert all(r.verified for r in merkle.prove(found, some).collect())


def test_missing_is_the_least_set():
    rng = np.random.default_rng(1)
    for size in (1, 2, 16, 17, 300, 5_000):
        places = rng.choice(size, min(size, 9), replace=False)
        known, asked = [set(places.tolist())], {(level, at) for level, found in merkle.missing(places, size) for at in found.tolist()}
        level, width = 0, size
        while width > 1:
            runs = {at // 16 for at in known[-1]}
            for run in runs:
                for at in range(run * 16, min(run * 16 + 16, width)):
                    assert (at in known[-1]) != ((level, at) in asked)
                    asked.discard((level, at))
            known.append(runs)
            level, width = level + 1, -(-width // 16)
        assert not asked


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got(merkle.audit(spark.read.parquet(f"{sf}/documents.parquet"))) == sorted(con.execute(merkle.SQL).fetchall(), key=str)
