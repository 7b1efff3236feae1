import hashlib
import random
import re
from collections import defaultdict

from tessera.llm import secret_scan
from tests.llm import cases

BASE = (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
        re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))


def slow_base(text):
    text, out = text or "", []
    # only the credential words are free of case; the value's class has both cases anyway
    out += [(m.start(), 0, m.end()) for m in BASE[0].finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in BASE[1].finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in BASE[2].finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def check(rows, found):
    expected = sorted(((r[0], *(sum(k == n for _, k, _ in slow_base(r[1])) for n in range(3)),
                        hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in slow_base(r[1])).encode()).hexdigest()) for r in rows), key=str)
    assert sorted((tuple(r[:5]) for r in found), key=str) == expected
    text = defaultdict(list)
    for r in rows:
        text[r[0]].append(r[1])
    for r in found:
        base = [f"{secret_scan.KINDS[k]}:{a}:{b}" for t in text[r.doc_id] for a, k, b in slow_base(t)]
        spans = r.spans.split(",") if r.spans else []
        assert {s for s in spans if not s.startswith("token")} <= set(base) and len(spans) >= r.n_assign + r.n_access + r.n_hex
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secret_scan.KINDS.index(s.split(":")[0])))


LIVE, COPIED, BARE = "aZ3kQ9xV7bN2mL5pR8tW", "Xx11Yy22Zz33Aa44Bb55Cc", "q7Wm2Zx9Lk4Tn8Vb3Rc6Yp"


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["token", "SECRET", "Api_Key", "apikey", "passwd", "password", "=", ":", " ", "  ", '"', "'", "abcdefgh", "x.y/z=9", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef",
            "é", "\n", "ſecret", "toKen", "deadbeef" * 4, "漢"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), "en", "s", 1) for i in range(400)]
    check(rows, secret_scan.findings(cases.docs(spark, rows)).collect())


def test_awkward_rows(spark):
    check(cases.ROWS, secret_scan.findings(cases.docs(spark)).collect())
    assert secret_scan.findings(cases.empty(spark)).collect() == []


def test_ownership_separates_examples_from_live_values(spark):
    rows = [(i, f"password = {COPIED}", "en", f"owner{i}", 1) for i in range(4)]
    rows += [(10, f"é secret: {LIVE}", "en", "me", 1), (11, f"see {LIVE} and again {LIVE}", "en", "me", 1), (12, f"bare {BARE}", "en", "me", 1),
             (13, f"bare {COPIED}", "en", "x", 1), (14, f"token=aaaaaaaaaaaaaaaaaaaa the-long-hyphenated-compound-word", "en", "me", 1), (15, f"z {BARE[::-1]}", "en", "x", 1),
             (16, f"z {BARE[::-1]}", "en", "y", 1)]
    found = {r.doc_id: r for r in secret_scan.findings(cases.docs(spark, rows)).collect()}
    assert all(found[i].n_example == 1 and found[i].n_live == 0 for i in range(4))
    assert found[10].n_live == 1 and found[10].spans == "assign:2:30"
    assert found[11].spans == "token:4:24,token:35:55" and found[11].n_live == 2 and found[11].found[0].repositories == 2
    assert found[12].spans == "token:5:27" and found[12].n_live == 1
    assert found[13].spans == f"token:5:{5 + len(COPIED)}" and found[13].n_example == 1 and found[13].found[0].owners == 5
    assert found[14].n_live == 0 and found[14].n_assign == 1 and "token" not in found[14].spans
    assert found[15].spans == "" and found[16].spans == ""  # a random string of two owners that never stood as a credential


def test_many_texts_of_one_owner_are_copies(spark):
    n = secret_scan.EXAMPLE_REPOSITORIES
    rows = [(i, f"password = {COPIED} in {i}", "en", "me", 1) for i in range(n)] + [(100 + i, f"bare {BARE} in {i}", "en", "me", 1) for i in range(n)]
    rows += [(200, f"token: {LIVE}", "en", "me", 1)] * n + [(201, f"token: {LIVE} or {LIVE}", "en", "me", 1)]
    found = {r.doc_id: r for r in secret_scan.findings(cases.docs(spark, rows)).collect()}
    assert all((found[i].n_example, found[i].n_live, found[i].found[0].repositories, found[i].found[0].owners) == (1, 0, n, 1) for i in range(n))
    assert all(found[100 + i].spans == "" for i in range(n))  # a string that many texts hold and that never stood as a credential
    assert found[200].n_live == 1 and found[201].n_live == 2 and found[200].found[0].repositories == 2  # repeated rows are one text
