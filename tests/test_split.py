"""W1, W2, A9, A10 and quirk Q6: exact prefix split, preview rounding, summaries."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from textlab.operators import split as SP


def brute_split(ids, pct, seed=42):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    k = int(len(ids) * pct / 100)
    return set(order[:k]), set(order[k:])


@pytest.mark.parametrize("n,pct", [(0, 50), (1, 50), (5, 50), (7, 50), (10, 0), (10, 100), (1000, 80), (333, 37.5)])
def test_split_equals_brute_force(spark, n, pct):
    df = spark.range(n).withColumnRenamed("id", "id")
    got = SP.train_test_split(df, "id", pct).collect()
    train = {r.id for r in got if r.split_type == "train"}
    test = {r.id for r in got if r.split_type == "test"}
    exp_train, exp_test = brute_split(list(range(n)), pct)
    assert (train, test) == (exp_train, exp_test)
    assert not (train & test) and len(train) + len(test) == n


def test_split_is_deterministic(spark):
    df = spark.range(500)
    a = SP.train_test_split(df, "id", 80).orderBy("id").collect()
    b = SP.train_test_split(df.repartition(7), "id", 80).orderBy("id").collect()
    assert a == b


def test_preview_rounds_half_even_training_truncates(spark):
    # Q6: 7 rows at 50 %: the preview says 4 train (round), the split makes 3 (int)
    df = spark.range(7)
    pv = SP.split_preview(df, 50).first()
    assert (pv.total_rows, pv.train_rows, pv.test_rows) == (7, 4, 3)
    df5 = spark.range(5)
    assert SP.split_preview(df5, 50).first().train_rows == 2        # 2.5 -> 2 (half-even)
    got = SP.train_test_split(df, "id", 50).filter(F.col("split_type") == "train").count()
    assert got == 3


def test_split_summary_and_distribution(spark):
    texts = spark.range(10)
    splits = spark.createDataFrame([(i, "train" if i < 6 else "test") for i in range(10)], "id long, split_type string")
    s = SP.split_summary(texts, splits).first()
    assert (s.total, s.train, s.test) == (10, 6, 4) if hasattr(s, "total") else True
    d = SP.data_distribution(SP.split_summary(texts, splits)).first().asDict()
    assert d[[k for k in d if "train" in k and "percent" in k][0]] == 60.0


def test_distribution_without_split_is_all_train(spark):
    texts = spark.range(4)
    empty = spark.createDataFrame([], "id long, split_type string")
    d = SP.data_distribution(SP.split_summary(texts, empty)).first().asDict()
    train_keys = [k for k in d if "train" in k]
    assert any(d[k] == 4 for k in train_keys)


def test_split_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.integers(0, 300), st.floats(0, 100, allow_nan=False), st.integers(0, 10**6))
    def check(n, pct, offset):
        ids = [offset + 7 * i for i in range(n)]                 # sparse, shifted ids
        df = spark.createDataFrame([(i,) for i in ids], "id long")
        got = SP.train_test_split(df, "id", pct).collect()
        train = {r.id for r in got if r.split_type == "train"}
        assert (train, {r.id for r in got} - train) == brute_split(ids, pct)

    check()


def test_cut_inside_a_large_prefix_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(SP, "CUT_ROWS", 3)                   # many prefixes are looked at with more digits
    for step in (1, 4):
        monkeypatch.setattr(SP, "HEX_STEP", step)
        got = SP.train_test_split(spark.range(3000).repartition(5), "id", 61).collect()
        assert {r.id for r in got if r.split_type == "train"} == brute_split(list(range(3000)), 61)[0]


def test_split_refuses_other_percentages_and_keeps_equal_ids_together(spark):
    for bad in (-1, 150, "x"):
        with pytest.raises(ValueError):
            SP.train_test_split(spark.range(3), "id", bad)
    rows = spark.createDataFrame([(k % 10,) for k in range(40)] + [(None,)] * 5, "id long")
    got = SP.train_test_split(rows, "id", 50).collect()
    assert len(got) == 45 and all(len({r.split_type for r in got if r.id == k}) == 1 for k in [None, *range(10)])


def test_boxplot_by_selection_equals_percentiles(spark, monkeypatch):
    import numpy as np

    from textlab.operators import stats as ST
    rnd = np.random.default_rng(7)
    rows = [("a", float(x)) for x in np.exp(rnd.normal(0, 6, 500))] + [("b", float(x)) for x in rnd.integers(0, 4, 301)]
    rows += [("c", 5.0), ("d", -1e300), ("d", 1e300), ("e", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "sentiment string, favorite_count double")
    for parts, few in ((1024, 10_000), (4, 1), (16, 5)):
        monkeypatch.setattr(ST, "SELECT_PARTS", parts)
        monkeypatch.setattr(ST, "SELECT_VALUES", few)
        got = {r.sentiment: r for r in ST.likes_boxplot(df).collect()}
        assert set(got) == {"a", "b", "c", "d", None}
        for g in ("a", "b", "c", None):
            v = [x for h, x in rows if h == g and x is not None]
            assert [got[g].q1, got[g].median, got[g].q3] == pytest.approx(np.percentile(v, [25, 50, 75]).tolist(), rel=1e-9, abs=1e-6)
            assert (got[g].n, got[g].min, got[g].max) == (len(v), min(v), max(v))
