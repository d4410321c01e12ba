"""Periodic runs against a brute-force search, and the query's digests against a plain version."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from rows import awkward, empty  # noqa: F401 - fixtures
from textlab.llm import periodic_runs as P
from textlab.llm.queries import op11_periodic_runs


def smallest_period(w: list) -> int:
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def brute(w: list) -> list[tuple[int, int, int]]:
    """Every run by trying all periods and extending word by word."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(12, 2 * q) and smallest_period(w[i:j + q]) == q:
                out.add((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rnd: random.Random) -> list[bytes]:
    kind, n, letters = rnd.random(), rnd.randint(0, 120), rnd.choice([1, 2, 2, 3, 4])
    w: list[int] = []
    if kind < 0.4:
        w = [rnd.randrange(letters) for _ in range(n)]
    elif kind < 0.8:
        while len(w) < n:
            part = [rnd.randrange(letters + 3) for _ in range(rnd.randint(1, 12))]
            w += part * rnd.randint(1, 6) + part[:rnd.randint(0, len(part))]
    else:
        a, w = [0], [0, 1]
        while len(w) <= n:
            a, w = w, w + a                                  # Fibonacci words: runs inside runs
    return [str(x).encode() for x in w]


def test_runs_equal_brute_force():
    rnd = random.Random(11)
    for _ in range(250):
        texts = [some_words(rnd) for _ in range(rnd.randint(1, 5))]
        runs, collapsed = P._texts(texts)
        assert runs == [brute(w) for w in texts]
        for w, r, c in zip(texts, runs, collapsed):
            gone = {i for a, n, q in r for i in range(a + q, a + n)}
            assert c == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_grammar_derives_the_texts():
    rnd = random.Random(3)
    texts = [some_words(rnd) for _ in range(20)]
    ids = np.array([int(x) for w in texts for x in w], np.int64)
    text = np.repeat(np.arange(20), [len(w) for w in texts])
    g = P.compress(ids, text)

    def derive(sym: int) -> list[int]:
        return [sym] if sym < g.words else derive(int(g.left[sym - g.words])) + derive(int(g.right[sym - g.words]))

    assert [x for s in g.root for x in derive(int(s))] == ids.tolist()
    for k in range(len(g.left)):
        lo, mid, hi = int(g.at.lo[k]), int(g.at.mid[k]), int(g.at.hi[k])
        assert derive(g.words + k) == ids[lo:hi].tolist() and derive(int(g.left[k])) == ids[lo:mid].tolist()
        assert text[lo] == text[hi - 1]


def test_equal_sums_of_different_words_are_not_believed(monkeypatch):
    rnd = random.Random(5)
    texts = [some_words(rnd) for _ in range(30)]
    monkeypatch.setattr(P, "_mixed", lambda v: (v % 2).astype(np.uint64))   # unlike words with equal sums
    assert P._texts(texts)[0] == [brute(w) for w in texts]


def test_long_and_repetitive_texts():
    assert P._texts([[b"w"] * 100_000])[0] == [[(0, 100_000, 1)]]
    line = [b"%d" % k for k in range(10)]
    unique = [b"u%d" % k for k in range(2000)]
    apart = [x for k in range(2000) for x in [*line, unique[k]]]
    assert P._texts([apart, line * 500]) == ([[], [(0, 5000, 10)]], [b" ".join(apart), b" ".join(line)])


def test_awkward_rows(awkward, empty):
    found = P.find_runs(awkward).collect()
    assert len(found) == 10 and all(r.runs == [] and r.collapsed == "" for r in found if r.n_words == 0)
    assert [(r.runs[0].start, r.runs[0].length, r.runs[0].period) for r in found if r.doc_id == 2] == [(0, 40_000, 1)] * 2
    assert {r.collapsed for r in found if r.doc_id == 2} == {"word end."}
    assert P.digests(P.find_runs(empty)).collect() == []


def test_query_equals_a_plain_version(spark, tmp_path):
    rows = [(k, " ".join(f"w{(k * i) % 37}" for i in range(k % 90))) for k in range(120)] + [(None, "a b"), (500, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc, text in rows:
        w, h = (text or "").split(), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            a, g = (h // 10) % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))], planted + 1
        runs = brute(w)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        row = got[doc]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 3 and len(got) == len(rows)


@pytest.mark.parametrize("n", [11, 12, 13])
def test_least_length(n):
    assert P._texts([[b"a", b"b"] * 3 + [b"x"], [b"a"] * n])[0] == [[], [(0, n, 1)] if n >= 12 else []]
