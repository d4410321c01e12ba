"""Nested samples, evaluation report JSON, rule and tree text files."""

from __future__ import annotations

import json

from textlab.operators import evaluate as EV
from textlab.operators import rules as R
from textlab.sources import reports as RP

LABELS = ["negative", "neutral", "positive"]
MATRIX = [[25, 2, 9], [3, 56, 21], [9, 11, 452]]


def test_nested_samples(spark, tmp_path):
    kinds = ["positive"] * 7 + ["negative"] * 8 + ["neutral"] * 5
    data = {"data": [{"text": f"t{i}", "metrics": {"likes": i, "dislikes": 20 - i}, "sentiment": s}
                     for i, s in enumerate(kinds)]}
    p = tmp_path / "samples.json"
    p.write_text(json.dumps(data, indent=2))
    df = RP.read_nested_samples(spark, str(p))
    rows = df.orderBy("pos").collect()
    assert len(rows) == 20 and rows[3].likes == 3 and rows[3].dislikes == 17 and rows[3].text == "t3"
    counts = {r.sentiment: r["count"] for r in df.groupBy("sentiment").count().collect()}
    assert counts == {"positive": 7, "negative": 8, "neutral": 5}


def test_evaluation_report_json_roundtrip(spark, tmp_path):
    rows = [(a, p) for i, a in enumerate(LABELS) for j, p in enumerate(LABELS) for _ in range(MATRIX[i][j])]
    df = spark.createDataFrame(rows, "actual string, predicted string")
    cm = EV.confusion_matrix(spark, df, labels=LABELS)
    rep = RP.evaluation_report(cm, EV.classification_report(cm), LABELS)
    path = str(tmp_path / "eval")
    RP.write_json(rep, path)
    back = RP.read_json(spark, path).first()
    assert [list(r) for r in back.confusion_matrix] == MATRIX
    assert list(back.labels) == LABELS
    acc = [r for r in back.classification_report if r["class"] == "accuracy"][0]
    assert abs(acc.f1 - 0.906463) < 1e-6
    assert RP.read_json(spark, str(tmp_path / "absent")) is None


def test_rules_text_file(spark, tmp_path):
    path = str(tmp_path / "rules_txt")
    RP.write_lines(R.rules_text(spark, R.shipped_rules(spark)), path, ["line_no"])
    text = [r.value for r in spark.read.text(path).collect()]
    assert "JIKA confidence >= 0.8 MAKA Very High Positive" in text
