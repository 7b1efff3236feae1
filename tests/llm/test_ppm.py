import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import ppm
from tests.llm import cases


def held_out(doc_id, parts=10):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == 0


def lowered(text):
    return (text or "").encode().lower()


class Trie:
    """The model by its definition: nested dictionaries and explicit sets of excluded bytes."""

    def __init__(self, order):
        self.order, self.nodes = order, defaultdict(Counter)

    def learn(self, text):
        for context, byte in self.steps(text):
            for k in range(self.order + 1):
                self.nodes[context[len(context) - k:]][byte] += 1

    def steps(self, text):
        whole = b"\xfe" * self.order + text + b"\xff"
        return [(whole[i - self.order: i], whole[i]) for i in range(self.order, len(whole))]

    def probability(self, context, byte):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(context[len(context) - k:])
            if not node:
                continue
            left = {x: n for x, n in node.items() if x not in excluded}
            total = sum(left.values()) + len(left)
            if byte in left:
                return p * left[byte] / total
            if left:
                p *= len(left) / total
            excluded |= set(node)
        return p / (256 - len(excluded))

    def score(self, text):
        return sum(math.log10(self.probability(*x)) for x in self.steps(text))


def brute(rows, order=ppm.ORDER):
    trie, words = Trie(order), Counter()
    for doc_id, text, *_ in rows:
        if not held_out(doc_id):
            trie.learn(lowered(text))
            words.update([*lowered(text).split(), None])
    n, v = sum(words.values()), len(words)
    out = []
    for doc_id, text, *_ in rows:
        tokens = [*lowered(text).split(), None]
        base = sum(math.log10((words[w] + .1) / (n + .1 * (v + 1))) for w in tokens)
        out.append(((doc_id, held_out(doc_id), len(tokens), sum(words[w] > 0 for w in tokens), n), base, trie.score(lowered(text))))
    return sorted(out, key=str)


def same(df, expected):
    found = sorted(((tuple(r[:5]), r[5], r[6]) for r in df.collect()), key=str)
    assert [x[0] for x in found] == [x[0] for x in expected]
    for x, y in zip(found, expected):
        assert x[1:] == pytest.approx(y[1:], rel=1e-9)


SHORT = [r for r in cases.ROWS if r[0] != 6] + [(i, f"the cat {i} sat on THE mat {i % 3}\n", "en", "a", 1) for i in range(30, 70)]


def test_awkward_rows(spark):
    assert any(held_out(r[0]) for r in SHORT)
    same(ppm.score(cases.docs(spark, SHORT)), brute(SHORT))
    assert ppm.score(cases.empty(spark)).collect() == []


def test_a_long_text(spark):
    same(ppm.score(cases.docs(spark)), brute(cases.ROWS))


@pytest.mark.parametrize("order", [1, 3])
def test_blocks_and_order_do_not_matter(spark, order):
    same(ppm.score(cases.docs(spark, SHORT).repartition(4), order=order, block=200), brute(SHORT, order))


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(200) if held_out(i)][:3]
    rows = [(i, "abc", "en", "a", 1) for i in ids]
    for r in ppm.score(cases.docs(spark, rows)).collect():
        assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-4 * math.log10(256))


def test_probabilities_of_a_context_sum_to_one(spark):
    text = b"abracadabra banana cabana"
    trie = Trie(2)
    trie.learn(text)
    seen, _ = ppm.grams([text], 2)
    every = {(int(x) >> 8 << 8) | b for x in seen.tolist() for b in range(256)} | {(0x7A7A << 8) | b for b in range(256)}
    counts = Counter(seen.tolist())
    rows = spark.createDataFrame([(x, counts.get(x, 0)) for x in every], "number long, n long")
    total = ppm.code_lengths(rows, 2).groupBy(F.shiftright("number", 8).alias("c")).agg(F.sum(F.pow(F.lit(10.0), "v")).alias("p"))
    assert all(r.p == pytest.approx(1) for r in total.collect())


def test_registered_query_and_held_out_accuracy(spark, sf):
    from tessera.llm.queries import QUERIES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    out = QUERIES["op11_ppm"](spark, sf)
    same(out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), brute(rows))
    sizes = {r[0]: len(lowered(r[1])) + 1 for r in rows}
    held = [r for r in out.collect() if r.held_out]
    bits = sum(-r.score for r in held) / math.log10(2) / sum(sizes[r.doc_id] for r in held)
    assert bits < 4  # eight without a model
