import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tessera.llm import align
from tests.llm import cases

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    a.no_truncation()
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(library, text):
    """(id, bytes) of both tokenizers, or nothing."""
    if not text:
        return [], []
    a, b = library
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [x for x in range(256) if x not in plain]
    byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])


def spans(found):
    out, at = [], 0
    for i, raw in found:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(library, rows):
    linked, docs = Counter(), []
    for doc_id, text, *_ in rows:
        a, b = map(spans, tokens(library, text))
        links, at = [], 0
        for i, x, y in a:
            while at < len(b) and b[at][2] <= x:
                at += 1
            k = at
            while k < len(b) and b[k][1] < y:
                links.append((i, b[k][0]))
                k += 1
        linked.update(links)
        cuts, groups = sorted({y for *_, y in a} & {y for *_, y in b}), []
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, x, y in t if low <= x and y <= high) for t in (a, b)) if len(a) < 3_000 else None)
        docs.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and groups[0] else "" if not a else None))
    most = defaultdict(int)
    for (_, b), n in linked.items():
        most[b] = max(most[b], n)
    return sorted(((i, n_a, n_b, g, len(links), sum(linked[x] == most[x[1]] for x in links), sum(linked[x] for x in links), sha) for i, n_a, n_b, g, links, sha in docs), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(found, expected):
    assert len(found) == len(expected)
    for x, y in zip(found, expected):
        assert x[:7] == y[:7] and (y[7] is None or x[7] == y[7])


def test_awkward_rows(spark, library):
    rows = cases.ROWS + [(20, "<|endoftext|> <s> </s> <unk> <0x41>", "en", "a", 1), (21, "a▁b", "en", "a", 1), (22, "x" + " " * 3_000 + "\t\n\x00y", "en", "a", 1),
                         (23, "7" * 500 + "漢字かな" * 50 + "😀" * 40, "xx", "a", 1), (24, " leading", "en", "a", 1), (24, " leading", "en", "a", 1)]
    expected = brute(library, rows)
    same(got(align.align(cases.docs(spark, rows), *PATHS)), expected)
    # small blocks: the same counts over the whole table
    same(got(align.align(cases.docs(spark, rows).repartition(3), *PATHS, block=64)), expected)
    assert align.align(cases.empty(spark), *PATHS).collect() == []
    none = [(1, None, "en", "a", 1), (2, "", "en", "a", 1)]
    assert got(align.align(cases.docs(spark, none), *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_registered_query(spark, library, sf):
    from tessera.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    names = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    same(got(QUERIES["op12_align"](spark, sf).select(*names)), brute(library, rows))


def test_shared_groups():
    rng = random.Random(3)
    for trial in range(300):
        n, dense = rng.randint(1, 200), rng.choice([.02, .1, .5, .9])
        ends = [np.array(sorted({*(x for x in range(1, n) if rng.random() < dense), n})) for _ in range(2)]
        a, b = ends
        groups = align.shared_groups(a, b, *(np.array([x]) for x in (0, len(a), 0, len(b))))
        cuts = sorted({*a.tolist()} & {*b.tolist()})
        assert a[groups[1] - 1].tolist() == cuts == b[groups[3] - 1].tolist()
        assert groups[0].tolist() == [0, *groups[1][:-1]] and groups[2].tolist() == [0, *groups[3][:-1]]


def test_a_long_interval_without_a_cut():
    n = 400_000
    a, b = np.arange(1, n + 1) * 2, np.append(np.arange(1, n) * 2 + 1, 2 * n)
    groups = align.shared_groups(a, b, *(np.array([x]) for x in (0, n, 0, n)))
    assert groups.tolist() == [[0], [n], [0], [n]]


def test_long_runs(library):
    pair = align.pair_of(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    for text in (" " * 300_000, "a" * 100_000, "\t" * 100_000):
        (a, b), = pair.encode([text])
        assert a and b


def test_the_faster_matcher_gives_the_same_ids(library):
    rng, pair = random.Random(11), align.pair_of(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    assert pair.cuts and pair.fast
    letters = "abcdefgstrelvdmXYZ0123456789'-_=+/.,;:!?<>|#\n  "
    for n in [*range(1, 60)] * 20 + [4_000] * 5:
        text = "".join(rng.choice(letters) for _ in range(n))
        assert [x[0] for x in pair.encode([text], True)] == [x[0] for x in pair.encode([text])]
    vocabulary = [t for t in pair.bytes_a if t.isascii() and len(t) > 2]
    text = b"".join(rng.choice(vocabulary) for _ in range(20_000)).decode()
    text = "".join(c for c in text if c.isprintable() or c == "\n")
    assert [*pair.encode([text], True)] == [*pair.encode([text])]
