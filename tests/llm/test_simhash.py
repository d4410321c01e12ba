"""SimHash against a direct computation, the index against all distances, and the groups against brute-force components."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rows import SF, awkward, documents, empty  # noqa: F401 - fixtures
from textlab.llm import simhash
from textlab.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct(text: str, n: int) -> int:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes: list[int], bits: int) -> list[int]:
    low = list(range(len(codes)))
    for _ in codes:
        for i in range(len(codes)):
            for j in range(len(codes)):
                if (codes[i] ^ codes[j]).bit_count() <= bits:
                    low[i] = low[j] = min(low[i], low[j])
    return low


@pytest.mark.parametrize("text", ["", "one", "One two three", "a b c d e", "x " * 500, "É é z\x0bq A"])
def test_fingerprint_is_the_direct_one(text):
    assert simhash.simhash(text.encode(), 4) == direct(text, 4)


@pytest.mark.parametrize("seed", range(6))
def test_index_links_as_all_distances_do(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    noise = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 6)).astype(np.uint64), initial=np.uint64(0))
                      for _ in range(400)], np.uint64)
    codes = np.unique(base[rng.integers(0, 12, 400)] ^ noise)
    bucket = (codes >> np.uint64(62)).astype(np.int64)
    root = simhash.link(bucket, codes, 4)
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        low = components([int(c) for c in codes[own]], 4)
        assert [int(codes[own][k]) for k in low] == [int(c) for c in codes[root[own]]]


def test_groups_equal_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    codes = [direct(r.text, 4) for r in rows]
    low = components(codes, 4)
    for r, code, k in zip(rows, codes, low):
        same = [x.doc_id for x, j in zip(rows, low) if j == k]
        assert got[r.doc_id].fingerprint & (1 << 64) - 1 == code and got[r.doc_id].component_id == min(same)


def test_hot_buckets_are_cut_again_without_losing_links(spark):
    rng = np.random.default_rng(5)
    codes = sorted({int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64))) for _ in range(300)})
    df = spark.createDataFrame([(c if c < 1 << 63 else c - (1 << 64),) for c in codes], "code long")
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.link_fingerprints(df, 4, group_rows=64, hot_rows=20).collect()}
    low = components(codes, 4)
    classes = {}
    for c, k in zip(codes, low):
        classes.setdefault(k, set()).add(c)
    want = sorted(sorted(v) for v in classes.values())
    have = {}
    for c in codes:
        have.setdefault(got.get(c, c), set()).add(c)
    assert sorted(sorted(v) for v in have.values()) == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}


def test_awkward_rows(spark, awkward, empty):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    ids = {r.fingerprint: r.component_id for r in got}
    assert ids[0] == 1                                    # null, empty and blank texts are one group
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 6]      # two groups have a 6 as their smallest id
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_keeps_the_smallest_of_every_group(spark, documents):
    want = {r.component_id for r in simhash.near_duplicates(documents).select("component_id").distinct().collect()}
    assert sorted(r.doc_id for r in simhash.keep_one(documents).collect()) == sorted(want)
