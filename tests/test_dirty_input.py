"""Empty, blank and malformed input, appends, per-file encodings and headers, and what is never swallowed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textlab.functions.scoring import lexicon_scorer
from textlab.operators import split as SP
from textlab.plans import labelling as L
from textlab.sources import posts as P
from textlab.sources import store as ST
from textlab.streaming.labeling import label_posts_stream


scorer = lexicon_scorer(["good"], ["bad"])


def folder(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    return str(tmp_path)


@pytest.mark.parametrize("data", [b"full_text,favorite_count\n", b"full_text\n\"\"\n\"\"\n", b""])
def test_nothing_scorable_gives_zero_counts(spark, tmp_path, data):
    (tmp_path / "in.csv").write_bytes(data)
    res = L.label_file(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), scorer)
    assert res.labeled.count() == 0 and ST.load_view(spark, str(tmp_path / "out")).count() == 0
    assert {r.n for r in res.stats.collect()} == {0}
    assert res.progress.first().saved == 0


@pytest.mark.parametrize("ids", [[], [5], [None, None], [3, None, 1]])
def test_positions_of_few_or_null_keys(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    rows = SP.key_order_index(df, "id", n_buckets=4).collect()
    assert sorted(r.row_idx for r in rows) == list(range(len(ids)))
    keyed = [r.id for r in sorted(rows, key=lambda r: r.row_idx) if r.id is not None]
    assert keyed == sorted(keyed)


def test_split_preview_of_no_rows_has_the_requested_percents(spark):
    r = SP.split_preview(spark.createDataFrame([], "id long"), 70).first()
    assert (r.total_rows, r.train_rows, r.train_percent, r.test_percent) == (0, 0, 70.0, 30.0)


def test_damaged_ids_and_surplus_fields(spark, tmp_path):
    data = b'full_text,id_str\nfirst,1.87E+18\nsecond,2\nextra,3,\nextra2,4,,x\n"quoted, with ""marks""\nand a line",5\nshort\n"long ""one""",6,"a\nb"\n'
    (tmp_path / "in.csv").write_bytes(data)
    res = L.label_file(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), scorer)
    assert {r.text for r in res.labeled.collect()} == {"first", "second", 'quoted, with "marks"\nand a line', "short"}
    bad = [r.record for r in spark.read.parquet(res.quarantine).filter("reason = 'too many fields'").collect()]
    assert sorted(b.strip() for b in bad) == ['"long ""one""",6,"a\nb"', "extra,3,", "extra2,4,,x"]


def test_each_file_has_its_own_encoding_and_header(spark, tmp_path):
    path = folder(tmp_path, a="full_text,username\ncafé � ok,anna\n".encode(), b="username,full_text\nbob,naïve\n".encode("latin-1"),
                  c=b"full_text,username\nplain,carl\n")
    got = {(r.full_text, r.username) for r in P.read_posts_with_fallback(spark, path).collect()}
    assert got == {("café � ok", "anna"), ("naïve", "bob"), ("plain", "carl")}


def test_appending_twice_keeps_ids_distinct_and_the_view_whole(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,text,sentiment,confidence\n7,one,positive,0.9\n9,two,negative,0.8\n")
    base = str(tmp_path / "store")
    for _ in range(3):
        L.import_csv(spark, str(tmp_path / "in.csv"), base, mode="append")
    assert sorted(r.id for r in spark.read.parquet(f"{base}/texts").collect()) == [1, 2, 3, 4, 5, 6]
    assert ST.load_view(spark, base).count() == 6


def test_a_broken_registry_or_rule_table_is_an_error(spark, tmp_path):
    broken = tmp_path / "rules" / "rule_type=confidence_level"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        L.resolve_rules(spark, str(tmp_path / "rules"), None)
    version = tmp_path / "registry" / "v-000000000-x"
    version.mkdir(parents=True)
    (version / "part-0.parquet").write_bytes(b"not parquet")
    assert ST.get_model(spark, str(tmp_path), "m") is None           # no success mark: never finished
    (version / "_SUCCESS").write_bytes(b"")
    with pytest.raises(Exception):
        ST.get_model(spark, str(tmp_path), "m")


def test_blank_batches_do_not_stop_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    cols = ["full_text", "id_str"]
    (tmp_path / "in" / "a.csv").write_text("full_text,id_str\n,1\n,2\n")
    (tmp_path / "in" / "b.csv").write_text("full_text,id_str\nhello,3\nextra,4,\n")
    label_posts_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), scorer, columns=cols).awaitTermination()
    assert [r.text for r in ST.load_view(spark, str(tmp_path / "out")).collect()] == ["hello"]
    led = spark.read.parquet(str(tmp_path / "out" / "ledger")).agg(F.sum("rows").alias("r"), F.sum("saved").alias("s")).first()
    assert (led.r, led.s) == (3, 1)


def test_labelling_takes_csv_names_only(spark, tmp_path):
    with pytest.raises(ValueError):
        L.label_file(spark, str(tmp_path / "in.xlsx"), str(tmp_path / "out"), scorer)


def test_a_scope_deletes_its_scratch_tables_only(spark):
    from textlab.sources.scratch import materialize, temporary
    before = materialize(spark.range(3), "kept")
    with temporary(spark):
        inner = materialize(spark.range(5), "gone")
        files = inner.inputFiles()
        with temporary(spark):
            materialize(spark.range(2), "inner")
        assert inner.count() == 5
    assert before.count() == 3 and not any(ST.path_exists(spark, f) for f in files)


def test_stream_reads_each_file_by_its_own_header_and_encoding(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    path = folder(inbox, a="username,full_text,id_str\nanna,good café,1\nx,extra,2,\n".encode(),
                  b="full_text,id_str,favorite_count\nbad naïve,2,7\n".encode("latin-1"), c=b"", d=b"full_text\r\n\"two\r\nlines\"\r\n")
    (inbox / "notes.txt").write_text("no posts")
    label_posts_stream(spark, path, str(tmp_path / "out"), scorer).awaitTermination()
    got = {(r.text, r.username, r.sentiment, r.favorite_count) for r in ST.load_view(spark, str(tmp_path / "out")).collect()}
    assert {g[0].replace("\r\n", "\n") for g in got} == {"good café", "bad naïve", "two\nlines"}
    assert ("good café", "anna", "neutral", 0) in got or ("good café", "anna", "positive", 0) in got
    assert {g[3] for g in got if g[0] == "bad naïve"} == {7}
    bad = spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()
    assert [(r.reason, r.record.strip()) for r in bad] == [("too many fields", "x,extra,2,")]
    led = spark.read.parquet(str(tmp_path / "out" / "ledger")).agg(F.sum("rows").alias("r"), F.sum("saved").alias("s")).first()
    assert (led.r, led.s) == (3, 3)


def test_a_replayed_stream_stores_the_same_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text(f"full_text,id_str\ngood {k},{k}\nbad,{k + 10}\n")
    for k in range(2):                                   # the second run has no checkpoint: every batch comes again
        label_posts_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), scorer, checkpoint=str(tmp_path / f"ck{k}")).awaitTermination()
    view = ST.load_view(spark, str(tmp_path / "out"))
    assert view.count() == 6 and view.select("id").distinct().count() == 6
