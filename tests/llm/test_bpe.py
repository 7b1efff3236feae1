import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tessera.llm import bpe
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
DESCRIPTION = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def transducer(entries):
    return bpe.Transducer(np.frombuffer(bpe.compile_transducer(entries), np.uint8))


def encoder(words=("the", "of", "don't", "the,", "été")):
    tok = bpe.Tokenizer(DESCRIPTION)
    return bpe.Encoder(DESCRIPTION, transducer((w.encode(), tok.word_ids(w)) for w in words))


TEXTS = ["", "Hello  world don't I'LL", "a<|endoftext|>b <|startoftext|>", " <|endoftext|> <|endoftext|>x", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ Σ", "İstanbul I",
         "x\x1cy \x1d z\x85q\xa0r", "ſtoken K", "½ ² Ⅷ 12", "été", "'s't're", "日本語テスト", "😀😀 a😀b", "\x00a\x01", "a​b", "՘ვ0x"]


def test_like_the_library(library):
    rng = random.Random(1)
    letters = "abcdeAÉé ñß'stlrevd1²,.|-<>\n\t́ΣσİI漢😀\xa0\x1c_"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2_000)]
    e = encoder()
    for text, ids in zip(texts, e.encode(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert e.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_merging_side_by_side_is_merging_alone():
    rng, tok = random.Random(8), bpe.Tokenizer(DESCRIPTION)
    pieces = [rng.choice(["the", "ing", "é", "漢"]) * rng.randint(1, 12) + "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(0, 20))) for _ in range(3_000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.merge_all(pieces)] == [tok.piece_ids(p) for p in pieces]
    assert tok.merge_all([]) == []


def test_transducer_is_minimal_and_exact():
    words = sorted({a + b for a in ("", "re", "un", "over") for b in ("load", "loads", "loading", "do", "does", "doing")} | {"", "é"})
    t = transducer((w.encode(), [i, i + 1]) for i, w in enumerate(words))
    assert t.numbers([w.encode() for w in words]).tolist() == sorted(range(len(words)), key=lambda i: words[i].encode())
    assert all(np.frombuffer(t.output(int(t.numbers([w.encode()])[0])), "<u4").tolist() == [words.index(w), words.index(w) + 1] for w in words)
    assert t.numbers([b"loa", b"unloadss", b"x", b"reo"]).tolist() == [-1] * 4
    # two states of a minimal automaton never have the same finality and arcs
    arcs = {}
    for key, to in zip(t.keys.tolist(), t.targets.tolist()):
        arcs.setdefault(key >> 8, []).append((key & 255, to))
    signatures = [(int(f), tuple(arcs.get(s, ()))) for s, f in enumerate(t.final)]
    assert len(set(signatures)) == len(signatures)
    assert len(signatures) < len({w[:i] for w in words for i in range(len(w) + 1)})
    nothing = transducer([])
    assert nothing.numbers([b"", b"a"]).tolist() == [-1, -1]


@pytest.mark.parametrize("lexicon", [0, 3, 1000])
def test_awkward_rows(spark, library, lexicon):
    rows = bpe.encode(cases.docs(spark), PATH, lexicon_size=lexicon, digests=True).collect()
    expected = []
    for doc_id, text, *_ in cases.ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert bpe.encode(cases.empty(spark), PATH).collect() == []


def test_ids_and_text(spark, library):
    for r in bpe.encode(cases.docs(spark), PATH).collect():
        assert library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) == r.decoded


def test_word_counts_cover_all_texts(spark):
    counted = {r.word: r.n for r in bpe.word_counts(cases.docs(spark), DESCRIPTION).collect()}
    tok, expected = bpe.Tokenizer(DESCRIPTION), {}
    for _, text, *_ in cases.ROWS:
        for w in tok.words(text or ""):
            expected[w] = expected.get(w, 0) + 1
    assert counted == expected


def test_long_pieces_are_merged_in_time(library):
    import time
    tok, rng = bpe.Tokenizer(DESCRIPTION), random.Random(9)
    pieces = ["a" * n for n in (31, 32, 33, 34, 100, 999)] + ["".join(rng.choice("acgt") for _ in range(n)) for n in (33, 500, 5_000)] + \
        ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (40, 3_000)] + ["漢字かな" * 50]
    for piece in pieces:
        assert tok.piece_ids(piece) == library.encode(piece, add_special_tokens=False).ids
    long = "".join(rng.choice("acgt") for _ in range(1_000_000))
    start = time.perf_counter()
    ids = tok.piece_ids(long)
    assert time.perf_counter() - start < 60 and ids == library.encode(long, add_special_tokens=False).ids
