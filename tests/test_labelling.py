"""P3-P5, R6, A21, A22 and quirks Q1, Q3, Q9: end-to-end labelling of post files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from textlab.functions.scoring import lexicon_scorer
from textlab.plans import labelling as L

HEADER = "conversation_id_str,created_at,favorite_count,full_text,id_str,username\n"
ROWS = [
    ("1", "Mon Dec 30 14:24:08 +0000 2024", "206", "Bagus sekali, senang! @user https://t.co/x", "11", "ann"),
    ("2", "Mon Dec 30 15:00:00 +0700 2024", "1000", "Buruk dan jelek #kecewa", "12", "bob"),
    ("3", "Tue Dec 31 01:02:03 +0000 2024", "", "biasa saja", "13", "cy"),
    ("4", "Tue Dec 31 01:02:03 +0000 2024", "5", "", "14", "dee"),
]
POS, NEG = ["bagus", "senang"], ["buruk", "jelek", "kecewa"]


def write_csv(tmp_path, name, rows, header=HEADER):
    lines = [header] + [",".join(f'"{v}"' for v in r) + "\n" for r in rows]
    p = tmp_path / name
    p.write_text("".join(lines))
    return str(p)


def test_label_file_end_to_end(spark, tmp_path):
    path = write_csv(tmp_path, "posts.csv", ROWS)
    res = L.label_file(spark, path, str(tmp_path / "store"), lexicon_scorer(POS, NEG))
    got = {r.id: r for r in res.labeled.collect()}
    assert set(got) == {11, 12, 13}                          # empty text skipped (F2)
    assert got[11].sentiment == "positive" and got[12].sentiment == "negative" and got[13].sentiment == "neutral"
    assert got[11].preprocessed_text == "bagus sekali senang"
    # Q1: likes of 1000 and 206 keep their rows and get the default popularity labels
    assert got[12].popularity == "Viral Negative" and got[11].popularity == "Popular"
    assert got[13].favorite_count == 0                        # blank likes -> 0 (Q3 / T12)
    assert str(got[12].created_at) == "2024-12-30 15:00:00"   # wall clock kept
    p = res.progress.first()
    assert (p.rows, p.saved, p.skipped) == (4, 3, 1)
    stats = {r.sentiment: (r.n, r.pct) for r in res.stats.collect()}
    assert stats == {"positive": (1, 33.3), "negative": (1, 33.3), "neutral": (1, 33.3)}
    miss = {r.column_name: r.missing for r in res.missing.collect()}
    assert miss["location"] is True and miss["username"] is False
    view = spark.read.parquet(res.paths["sentiments"])
    assert view.count() == 3


def test_scorer_error_rows_are_skipped_not_fatal(spark, tmp_path):
    def make():
        def score(texts):
            if any("boom" in t for t in texts):
                if len(texts) > 1:
                    raise ValueError("batch")
                raise ValueError("bad row")
            return [[0.0, 1.0, 0.0] for _ in texts]
        return score
    path = write_csv(tmp_path, "p.csv", [("1", "", "1", "fine", "1", "a"), ("2", "", "1", "boom", "2", "b")])
    res = L.label_file(spark, path, str(tmp_path / "s"), make)
    assert [r.id for r in res.labeled.collect()] == [1]
    p = res.progress.first()
    assert (p.rows, p.saved, p.skipped) == (2, 1, 1)


def test_create_labeled_dataset_tags_both_files(spark, tmp_path):
    a = write_csv(tmp_path, "a.csv", ROWS[:2])
    b = write_csv(tmp_path, "b.csv", ROWS[2:3])
    res, mined = L.create_labeled_dataset(spark, a, b, str(tmp_path / "store"), lexicon_scorer(POS, NEG),
                                          rules_out=str(tmp_path / "rules"))
    tags = {r.id: r.source_dataset for r in res.labeled.collect()}
    assert tags == {11: "data_latih_1", 12: "data_latih_1", 13: "data_latih_2"}
    assert mined.count() == 0                                  # no pattern has more than 10 rows


def test_resolve_rules_fallback_chain(spark, tmp_path):
    from textlab.operators.rules import rule_list
    from textlab import schema as S
    # nothing stored, no file: shipped defaults
    assert rule_list(L.resolve_rules(spark, str(tmp_path / "none"), None)) == \
        [(n, t, lab) for n, t, _c, lab in S.SHIPPED_CONFIDENCE_RULES]
    f = tmp_path / "rules.json"
    f.write_text(json.dumps({"confidence_rules": {"x_high": {"threshold": 0.7, "count": 3, "label": "X"}}}))
    assert rule_list(L.resolve_rules(spark, str(tmp_path / "none"), str(f))) == [("x_high", 0.7, "X")]


def test_import_csv_with_defaults(spark, tmp_path):
    p = tmp_path / "import.csv"
    p.write_text("text,sentiment,confidence,favorite_count,created_at,source_dataset\n"
                 "hello,positive,0.9,12.0,2024-12-30 14:24:08,a\n"
                 ",,,,,\n")
    paths = L.import_csv(spark, str(p), str(tmp_path / "store"))
    from textlab.sources.store import load_view
    rows = sorted(load_view(spark, str(tmp_path / "store")).collect(), key=lambda r: r.text)
    assert [(r.text, r.sentiment, r.confidence, r.favorite_count, r.source_dataset) for r in rows] == \
        [("", "neutral", 0.0, 0, "imported"), ("hello", "positive", 0.9, 12, "a")]
    assert str(rows[1].created_at) == "2024-12-30 14:24:08"
    assert set(paths) == {"texts", "sentiments", "metadata"}


def test_resolve_labeled_source(spark, tmp_path):
    assert L.resolve_labeled_source(spark, str(tmp_path / "no"), str(tmp_path / "no.csv"), str(tmp_path / "x.csv")) \
        is None
    d = tmp_path / "default.csv"
    d.write_text("full_text,favorite_count\nhi,1\n")
    got = L.resolve_labeled_source(spark, str(tmp_path / "no"), str(tmp_path / "labeled_csv"), str(d))
    assert [r.full_text for r in got.collect()] == ["hi"]
    # the copy now exists and is preferred next time
    again = L.resolve_labeled_source(spark, None, str(tmp_path / "labeled_csv"), None)
    assert again.count() == 1


def test_execute_query_with_parameters(spark):
    from textlab.sources.store import execute_query
    df = spark.createDataFrame([(1, "positive"), (2, "negative")], "id long, sentiment string")
    out = execute_query(spark, "SELECT id FROM v WHERE sentiment = ?", ["negative"], {"v": df})
    assert [r.id for r in out.collect()] == [2]


def test_input_guards():
    import pytest
    from textlab.sources import posts as P
    assert P.check_percent("80") == 80.0
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            P.check_percent(bad)
    with pytest.raises(ValueError):
        P.check_text("   ")
    with pytest.raises(ValueError):
        P.check_csv_path("data.xlsx")
    assert P.check_csv_path("a.CSV") == "a.CSV"


def test_scorer_runs_once_per_row(spark, tmp_path):
    # Q9: the scorer output is stored once and every later result reads the stored rows
    acc = spark.sparkContext.accumulator(0)

    def make():
        def score(texts):
            acc.add(len(texts))
            return [[0.0, 1.0, 0.0] for _ in texts]
        return score
    path = write_csv(tmp_path, "posts.csv", ROWS)
    res = L.label_file(spark, path, str(tmp_path / "store"), make)
    res.labeled.collect()
    res.stats.collect()
    res.progress.collect()
    assert acc.value == 3
