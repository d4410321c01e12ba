"""The report follows from the published confusion matrix."""

from __future__ import annotations

import pytest

from textlab.operators import evaluate as EV

LABELS = ["negative", "neutral", "positive"]
# published run: rows = true class, columns = predicted class
MATRIX = [[25, 2, 9], [3, 56, 21], [9, 11, 452]]
EXPECTED = {  # precision, recall, f1, support
    "negative": (0.6757, 0.6944, 0.6849, 36),
    "neutral": (0.8116, 0.7000, 0.7517, 80),
    "positive": (0.9378, 0.9576, 0.9476, 472),
    "macro avg": (0.8083, 0.7840, 0.7947, 588),
    "weighted avg": (0.9045, 0.9065, 0.9049, 588),
}


def rows_from_matrix():
    out = []
    for i, a in enumerate(LABELS):
        for j, p in enumerate(LABELS):
            out += [(a, p)] * MATRIX[i][j]
    return out


def test_report_matches_published_numbers(spark):
    df = spark.createDataFrame(rows_from_matrix(), "actual string, predicted string")
    cm = EV.confusion_matrix(spark, df, labels=LABELS)
    got = {(r.actual, r.predicted): r.n for r in cm.collect()}
    assert got == {(a, p): MATRIX[i][j] for i, a in enumerate(LABELS) for j, p in enumerate(LABELS)}
    rep = {r["class"]: r for r in EV.classification_report(cm).collect()}
    for cls, (p, r, f, s) in EXPECTED.items():
        assert rep[cls].precision == pytest.approx(p, abs=6e-5)
        assert rep[cls].recall == pytest.approx(r, abs=6e-5)
        assert rep[cls].f1 == pytest.approx(f, abs=6e-5)
        assert rep[cls].support == s
    assert rep["accuracy"].f1 == pytest.approx(0.9064625850340136, abs=1e-6)
    acc = EV.accuracy(df).first()
    assert acc.n == 588 and acc.accuracy == pytest.approx(0.906463, abs=1e-6)


def test_zero_denominators_give_zero(spark):
    df = spark.createDataFrame([("negative", "negative")], "actual string, predicted string")
    rep = {r["class"]: r for r in EV.classification_report(EV.confusion_matrix(spark, df, labels=LABELS)).collect()}
    assert rep["positive"].precision == 0.0 and rep["positive"].recall == 0.0 and rep["positive"].f1 == 0.0
    assert rep["negative"].f1 == 1.0
