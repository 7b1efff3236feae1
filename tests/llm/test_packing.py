import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import packing, warc
from tessera.session import scratch_path
from tests.llm import cases

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return packing.encoding(open(RANKS[0], "rb").read(), RANKS[1])


def slow_best_fit(lengths, capacity):
    """Of rows with equally little room the one filled last."""
    rows, room, filled = [], [], []
    for step, piece in enumerate(sorted(range(len(lengths)), key=lambda i: -lengths[i])):
        fits = [(room[i], -filled[i], i) for i in range(len(rows)) if room[i] >= lengths[piece]]
        at = min(fits)[2] if fits else len(rows)
        if not fits:
            rows.append([])
            room.append(capacity)
            filled.append(0)
        rows[at].append(piece)
        room[at] -= lengths[piece]
        filled[at] = step
    return rows


@pytest.mark.parametrize("capacity", [1, 2, 7, 8, 64, 100])
def test_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 5, 60, 300):
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        rows = packing.best_fit(lengths, capacity)
        assert sorted(p for r in rows for p in r) == list(range(n))
        assert all(sum(lengths[p] for p in r) <= capacity for r in rows)
        shape = lambda rows: Counter(tuple(lengths[p] for p in r) for r in rows)
        assert shape(rows) == shape(slow_best_fit(lengths, capacity))


def test_room_finds_the_least_that_fits():
    rng, room, model = random.Random(1), packing.Room(100), []
    for step in range(2_000):
        if rng.random() < .55:
            room.put(step, r := rng.randint(1, 100))
            model.append(r)
        else:
            need = rng.randint(1, 100)
            fits = [r for r in model if r >= need]
            found = room.take(need)
            assert (found and found[1]) == (min(fits) if fits else None)
            if found:
                model.remove(found[1])


def unpacked(rows, kind="<u2"):
    docs = defaultdict(list)
    for r in rows:
        ids, positions = np.frombuffer(r.ids, kind), np.frombuffer(r.positions, "<u2")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and len(r.doc_ids) == len(r.cu_seqlens) - 1
        assert not positions[r.n_tokens:].any() and len(set(ids[r.n_tokens:].tolist())) <= 1
        for doc_id, at, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a)) and b > a
            docs[doc_id].append((at, ids[a:b].tolist()))
    return docs


@pytest.mark.parametrize("window", [50, 1 << 20])
def test_lossless(spark, library, window):
    expected = defaultdict(list)
    for doc_id, text, *_ in cases.ROWS:
        ids = library.encode_ordinary(text or "")
        expected[doc_id] += [(at, ids[at: at + 64]) for at in range(0, len(ids), 64)]
    rows = packing.pack(cases.docs(spark), *RANKS, capacity=64, window=window).collect()
    assert {k: sorted(v) for k, v in unpacked(rows).items()} == {k: sorted(v) for k, v in expected.items() if v}
    assert all(len(r.ids) == 128 for r in rows) and len({(r.part, r.row) for r in rows}) == len(rows)
    assert packing.pack(cases.empty(spark), *RANKS).collect() == []


def test_registered_query_fills_its_rows(spark, library):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_packing"](spark, sf).collect()
    docs = unpacked(rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for doc_id, text in texts.items():
        assert library.decode([x for _, ids in sorted(docs.get(doc_id, [])) for x in ids]) == (text or "")
        assert [x for _, ids in sorted(docs.get(doc_id, [])) for x in ids] == library.encode_ordinary(text or "")
    assert sum(r.n_tokens for r in rows) >= .98 * packing.CAPACITY * len(rows)


@pytest.mark.parametrize("rows", [3, 8_192])
def test_matrices(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "ROWS", rows)
    packed = packing.pack(cases.docs(spark), *RANKS, capacity=64)
    whole = {(r.part, r.row): tuple(r) for r in packed.collect()}
    manifest = packing.write_matrices(packed, scratch_path(spark, "matrices"))
    assert sum(m.rows for m in manifest.collect()) == len(whole) and all(m.rows <= rows for m in manifest.collect())
    for m in manifest.collect():
        system, path = warc.file_system(m.stem)
        ids, cu = (system.open_input_stream(f"{path}.{end}").read() for end in ("ids", "cu"))
        cu = np.frombuffer(cu, "<u4").tolist()
        for k in range(m.rows):
            n = cu.pop(0)
            assert ids[128 * k: 128 * k + 128] == bytes(whole[m.part, m.row + k][3]) and cu[:n] == whole[m.part, m.row + k][5]
            cu = cu[n:]
        assert not cu
    back = packing.pack_to_files(cases.docs(spark), *RANKS, capacity=64).collect()
    assert {(r.part, r.row): tuple(r) for r in back} == whole
    assert packing.pack_to_files(cases.empty(spark), *RANKS).collect() == []


def test_long_runs_of_blanks(library):
    rng = random.Random(2)
    for blank in (" ", "\t", "\n", " \n", "\u3000", "\xa0 "):
        for n in (4_095, 4_096, 9_000):
            for text in (blank * n, "a" + blank * n, blank * n + "b c", "x  y" + blank * n + "z" + blank * n + "!", "." + blank * n + "\n7"):
                assert packing.token_ids(library, text) == library.encode_ordinary(text)
    for text in (" " * 5_000_000, "a" + "\t" * 5_000_000 + "b", "b" * 1_000_000, "".join(rng.choice(" \t\n") for _ in range(1_000_000)) + "end"):
        assert library.decode(packing.token_ids(library, text)) == text
