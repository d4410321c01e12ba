"""Language identification: held-out accuracy, spans of mixed texts, Viterbi against all paths, awkward rows."""

from __future__ import annotations

import itertools
import zlib

import numpy as np

from rows import SF, awkward, empty  # noqa: F401 - fixtures
from textlab.llm import language_id as L
from textlab.llm.queries import op12_language_id

SF_MID = "/root/testdata/sf0.01"


def test_best_path_equals_all_paths():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        langs, sizes = int(rnd.integers(1, 4)), rnd.integers(0, 7, 5)
        e = rnd.integers(-9, 0, (6, langs)).astype(float)
        ids = rnd.integers(0, 6, sizes.sum())
        found, a = L.best_path(e, ids, sizes, 3.0), 0
        for n in sizes:
            own = ids[a:a + n]

            def cost(path, own=own):
                return sum(e[w, s] for w, s in zip(own, path)) - 3.0 * sum(x != y for x, y in zip(path, path[1:]))

            best = max((cost(p) for p in itertools.product(range(langs), repeat=int(n))), default=0.0)
            assert cost(found[a:a + n].tolist()) == best
            a += n


def test_held_out_accuracy_and_query(spark):
    got = op12_language_id(spark, SF_MID).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert len(right) > 200 and sum(right) / len(right) > 0.99


def test_spans_of_mixed_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        by.setdefault(r.lang, []).append(" ".join(r.text.split()[:60]))
    mixed = [(10_000 + k, f"{a} {b} {c}", None) for k, (a, b, c) in enumerate(zip(by["fr"], by["en"], by["de"]))
             if min(len(a.split()), len(b.split()), len(c.split())) >= 50][:10]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    found = {r.doc_id: r for r in L.predict(table).collect()}
    assert len(mixed) >= 5
    good = sum([s.lang for s in found[d].spans] == ["fr", "en", "de"] for d, _, _ in mixed)
    assert good >= 0.8 * len(mixed)
    for doc, text, _ in mixed:
        spans = found[doc].spans
        assert all(text[s.start:s.end].strip() == text[s.start:s.end] for s in spans)
        assert all(x.end < y.start for x, y in zip(spans, spans[1:]))


def test_scripts_narrow_the_candidates(spark):
    ja = next(k for k in range(20, 40) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows = [(1, "die und der das ist nicht", "de"), (3, "the and of that is not", "en"), (4, "это не так и как все", "ru"),
            (ja, "これはペンです。日本語の文章。", "ja"), (7, "この本は日本語です", None), (8, "и это все", None), (9, "a and the", None),
            (10, "ไทย", None), (11, "123 ++ ___ ²½", "en"), (12, "́ ̈", None)]
    d = L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in d.collect()}
    learned = {r[2] for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert {"ru", "ja", "en"} <= learned
    assert (got[7].lang_pred, got[8].lang_pred, got[9].lang_pred) == ("ja", "ru", "en")
    assert got[10].lang_pred in learned                      # a script that nothing was learned of
    assert (got[11].lang_pred, got[11].score, got[12].lang_pred, got[12].spans) == ("und", 0.0, "und", [])


def test_awkward_rows(awkward, empty, spark):
    got = L.predict(awkward).collect()
    assert len(got) == 10
    assert all((r.lang_pred, r.score, r.spans) == ("und", 0.0, []) for r in got if r.doc_id in (1, 5))
    assert {r.lang_pred for r in got if r.doc_id == 2} <= {"en", "de"}
    assert L.predict(empty).collect() == []
    nothing = L.predict(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score, r.spans) for r in nothing] == [("und", 0.0, [])]
