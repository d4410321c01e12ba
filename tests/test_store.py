"""Normalised storage behind one view; ids shared; registry upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlab import schema as S
from textlab.sources import store as ST
from textlab.sources.tables import labeled


def test_save_and_view_roundtrip(spark, tmp_path):
    lab = labeled(spark, SF_SMALL).select(*S.LABELED_VIEW_COLUMNS, "has_metadata")
    paths = ST.save_labeled(spark, lab, str(tmp_path / "store"))
    texts = spark.read.parquet(paths["texts"])
    sents = spark.read.parquet(paths["sentiments"])
    meta = spark.read.parquet(paths["metadata"])
    n = lab.count()
    assert texts.count() == n and sents.count() == n
    assert meta.count() == lab.filter("has_metadata").count()
    # ids are dense 1..n and every sentiment / metadata row has its text (no orphans, Q10)
    ids = sorted(r[0] for r in texts.select("id").collect())
    assert ids == list(range(1, n + 1))
    assert sents.join(texts, sents.text_id == texts.id, "left_anti").count() == 0
    assert meta.join(texts, meta.text_id == texts.id, "left_anti").count() == 0
    view = ST.load_view(spark, str(tmp_path / "store"))
    assert view.count() == n
    assert set(S.LABELED_VIEW_COLUMNS) <= set(view.columns)
    assert ST.by_sentiment(view, "positive").count() == lab.filter(F.col("sentiment") == "positive").count()
    assert ST.fetch_all(view, 5).count() == 5
    assert ST.fetch_all(view, 0).count() == n          # limit 0 means no limit


def test_split_store_and_join(spark, tmp_path):
    from textlab.operators.split import train_test_split
    view = spark.createDataFrame([(i, f"t{i}") for i in range(1, 21)], "id long, text string")
    sp = train_test_split(view.select("id"), "id", 80).withColumnRenamed("id", "text_id")
    ST.save_dataset_splits(sp, str(tmp_path / "splits"))
    tr, te = ST.load_split(spark, view, str(tmp_path / "splits"))
    assert tr.count() == 16 and te.count() == 4
    assert tr.join(te, "id").count() == 0


def test_rules_store_replaces_one_type(spark, tmp_path):
    from textlab.operators.rules import shipped_rules
    path = str(tmp_path / "rules")
    ST.save_rules(shipped_rules(spark), path)
    got = ST.load_rules(spark, path).collect()
    assert [r.rule_name for r in got] == [n for n, *_ in S.SHIPPED_CONFIDENCE_RULES]


def test_export_csv(spark, tmp_path):
    view = spark.createDataFrame([(1, "a, b"), (2, "c")], "id long, text string")
    assert ST.export_csv(view, str(tmp_path / "out")) is True
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(r.text for r in back.collect()) == ["a, b", "c"]


def test_spread_only_underpartitioned_scans(spark, tmp_path):
    from textlab.sources.tables import spread
    target = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one, "id").rdd.getNumPartitions() == target
    many = spark.range(100).repartition(target + 2)
    assert spread(many, "id") is many                       # no shuffle added


def test_filter_and_projection_reach_the_scan(spark, tmp_path):
    lab = labeled(spark, SF_SMALL).select(*S.LABELED_VIEW_COLUMNS, "has_metadata")
    ST.save_labeled(spark, lab, str(tmp_path / "store"))
    view = ST.load_view(spark, str(tmp_path / "store"))
    q = ST.by_sentiment(view, "positive").select("id", "sentiment")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sentiment,positive)" in plan                     # predicate pushed into the Parquet scan
    assert "ReadSchema: struct<text_id:bigint,sentiment:string>" in plan or \
           "struct<text_id:bigint,sentiment:string>" in plan         # only the needed columns are read
    assert "preprocessed_text" not in plan


def test_dates_that_are_text_follow_the_store_rule(spark, tmp_path):
    dates = ["Tue Jan 02 03:04:05 +0000 2024", "2024-01-02 03:04:05", "2024-01-02", "soon", None, "Tue nonsense"]
    rows = [(i, "t", "t", "neutral", 0.5, 1, d, None, None, "s") for i, d in enumerate(dates)]
    df = spark.createDataFrame(rows, "id long, text string, preprocessed_text string, sentiment string, confidence double, "
                                     "favorite_count int, created_at string, location string, username string, source_dataset string")
    paths = ST.save_labeled(spark, df, str(tmp_path / "store"))
    got = [str(r.created_at) for r in spark.read.parquet(paths["texts"]).orderBy("id").collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", "None", "None", "None"]


def test_ids_are_allocated_on_keys_alone(spark, tmp_path, monkeypatch):
    import textlab.sources.store as ST
    seen = []
    real = ST.allocate_ids
    monkeypatch.setattr(ST, "allocate_ids", lambda df, *a, **k: (seen.append(df.columns), real(df, *a, **k))[1])
    rows = [(k, f"text {k}", "t", "neutral", 0.5, None, None, None, None, "src") for k in [7, 7, 3, None, 9]]
    df = spark.createDataFrame(rows, "id long, text string, preprocessed_text string, sentiment string, confidence double, favorite_count int, "
                                     "created_at timestamp_ntz, location string, username string, source_dataset string")
    paths = ST.save_labeled(spark, df, str(tmp_path / "store"))
    got = {r.id: r.text for r in spark.read.parquet(paths["texts"]).collect()}
    assert got == {1: "text 3", 2: "text 7", 3: "text 7", 4: "text 9", 5: "text None"}
    assert [c for cols in seen for c in cols if c in ("text", "preprocessed_text")] == [] and len(seen) == 1
