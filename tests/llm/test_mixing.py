"""The mix against iterative resharing and a plain walk over the schedule."""

from __future__ import annotations

import math
import re

import pytest

from rows import DOCS, SF, awkward, documents, empty  # noqa: F401 - fixtures
from textlab.llm import mixing
from textlab.sources.scratch import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        give = {s: 2 * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and give[s] > 2 * sizes[s]}
        if not over:
            return give
        full |= over


def check(docs, rows, slack):
    texts = docs.select("text", "source").collect()
    sizes: dict = {}
    for r in texts:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want, taken = reshared(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack, (s, taken[s], want[s])
    assert sorted(r.size for r in rows) == sorted(len(WORD.findall(r.text or "")) for r in texts)


def test_documents(documents):
    a = mixing.mix(documents).collect()
    check(documents, a, 6 * mixing.LEAST_BLOCK)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, a)) == sorted(map(key, mixing.mix(documents.repartition(7)).collect()))


def test_awkward_rows(awkward, empty):
    check(awkward, mixing.mix(awkward).collect(), 6 * 8)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(docs).count() == 0


def test_mixed_documents_hold_the_taken_words(documents):
    words: dict = {}
    for r in mixing.mixed_documents(documents).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.text
    assert words == {r.doc_id: r.taken for r in mixing.mix(documents).collect() if r.taken}


def test_every_prefix_of_the_schedule_is_near_the_shares(spark, documents):
    sized = materialize(mixing._sized(documents, "doc_id", "text", "source", 17), "t-sized")
    plan = materialize(mixing.source_plan(sized), "t-plan")
    share = {r.idx: min(r.hi, 1.0) - r.lo for r in plan.collect()}
    slots = [r.idx for r in mixing.schedule(plan).orderBy("slot").collect()]
    for n in (50, 500, len(slots)):
        for idx, p in share.items():
            assert abs(slots[:n].count(idx) - p * n) <= 8


@pytest.mark.parametrize("n", [0, 1, 5])
def test_ranks_count_from_zero_without_gaps(spark, documents, n):
    sized = materialize(mixing._sized(documents.limit(20 * n + 5), "doc_id", "text", "source", 17), "t-sized")
    rows = mixing.schedule(materialize(mixing.source_plan(sized), "t-plan")).collect()
    for idx in {r.idx for r in rows}:
        own = sorted((r.slot, r.rank) for r in rows if r.idx == idx)
        assert [r for _, r in own] == list(range(len(own)))


def test_small_sources_reach_their_target_in_a_large_corpus(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)                    # blocks of total / 64 words without a bound
    few = spark.createDataFrame([(10**6 + k, "some few words here now", "en", s, 23) for k, s in enumerate("zzy")], documents.schema)
    docs = documents.unionByName(few)
    check(docs, mixing.mix(docs).collect(), 1)


def test_blocks_do_not_grow_with_the_corpus(spark):
    sized = spark.createDataFrame([("a", 5 * 10**9), ("b", 1000)], "source string, size long")
    assert {r.block for r in mixing.source_plan(sized).collect()} == {mixing.MOST_BLOCK}


def test_equal_rows_share_what_is_taken_of_them(spark):
    rows = [(1, "a b c d e", "en", "s", 9)] * 7 + [(2, "f g h", "en", "s", 5)] * 4 + [(3, "i j", "en", None, 3)] * 3 + [(None, "k l", "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    want: dict = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    got: dict = {}
    for r in mixing.mixed_documents(docs).collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(r.text.split())
    assert got == {k: n for k, n in want.items() if n}
