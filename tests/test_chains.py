"""a large node is split in a task from counts that are made once; packed rows give the same trees, node by node."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textlab.operators import chains as CH, threshold_tree as T
from textlab.operators.node_cells import places


def _frames(spark, rows):
    r = spark.createDataFrame([(i, lab) for i, lab, _ in rows], "id long, label string")
    nz = spark.createDataFrame([(i, t, v) for i, _l, tf in rows for t, v in tf.items()], "id long, term string, tf long")
    return r, nz


def _rows(n=90, seed=7):
    """Mostly rare terms, so that every split takes off a few rows, and one that most rows have."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        tf = {f"t{rnd.randrange(30):02d}": rnd.choice([1, 1, 2, 4]) for _ in range(3)}
        if rnd.random() < 0.7:
            tf["wide"] = rnd.choice([1, 3])
        out.append((i, rnd.choice("abc"), tf))
    return out


def _nodes(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("peel_rows", [60, 9])
def test_threshold_chains_equal_the_tree_in_a_task(spark, peel_rows, monkeypatch):
    a, nz = _frames(spark, _rows())
    nz = nz.withColumnRenamed("tf", "value")
    want = _nodes(T.grow(a, nz))
    chains, counted = [], []
    pass_, count = CH.split_chains, CH.value_counts
    monkeypatch.setattr(CH, "split_chains", lambda *x: chains.append(1) or pass_(*x))
    monkeypatch.setattr(CH, "value_counts", lambda *x: counted.append(1) or count(*x))
    monkeypatch.setattr(CH, "LOCAL_CELLS", 60)
    got = T.grow(a, nz, local_cells=60, peel_rows=peel_rows)
    assert _nodes(got) == want
    large = len({r.depth for r in got.collect() if r.n > 20 and not r.is_leaf})
    assert large > 5 and 1 <= len(chains) == len(counted) < large          # a count a turn, not a count a level
    monkeypatch.undo()
    assert _nodes(T.grow(a, nz, peel_rows=peel_rows)) == want              # packed, in a task


def test_rows_of_a_repeated_id_are_not_packed(spark):
    a, nz = _frames(spark, _rows(12))
    twice = a.unionByName(a.limit(1))
    assert CH.vocabulary(twice, nz) is None and CH.vocabulary(a, nz) == sorted({r.term for r in nz.collect()})
    assert T.grow(twice, nz.withColumnRenamed("tf", "value"), peel_rows=50).count() > 1


def test_places_with_and_without_a_sort():
    rng = np.random.default_rng(3)
    for span in (50, 40_000_000):
        key = rng.integers(0, span, 300)
        got, want = places(key, span), np.unique(key, return_inverse=True)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
