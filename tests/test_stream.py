"""The streaming jobs give the same results as the batch plan on the same files."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlab.operators.rules import apply_rules
from textlab.plans.catalog import shipped_conf_rules
from textlab.sources.tables import labeled, table
from textlab.streaming import labeling as SL


def test_stream_equals_batch(spark, tmp_path):
    docs = table(spark, SF_SMALL, "documents")
    inbox = SL.stage_inbox(docs, str(tmp_path / "inbox"), n_files=3)
    vec, ev = table(spark, SF_SMALL, "embeddings"), table(spark, SF_SMALL, "events")
    out = str(tmp_path / "out")
    lab = SL.label_stream(SL.read_inbox(spark, inbox, docs.schema), vec, ev, shipped_conf_rules())
    q = SL.run_labeling(spark, lab, out, checkpoint=str(tmp_path / "ck1"))
    q.awaitTermination()
    stats = SL.running_stats(SL.label_stream(SL.read_inbox(spark, inbox, docs.schema), vec, ev))
    q2 = SL.run_running_stats(spark, stats, str(tmp_path / "stats"), checkpoint=str(tmp_path / "ck2"))
    q2.awaitTermination()

    batch = apply_rules(labeled(spark, SF_SMALL), shipped_conf_rules(), {}, None)
    cols = ["id", "sentiment", "confidence", "confidence_level"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/labeled").select(*cols).collect())
    want = sorted(tuple(r) for r in batch.filter(F.col("text") != "").select(*cols).collect())
    assert got == want

    led = SL.batch_ledger(spark, out).orderBy("batch_id").collect()
    assert len(led) == 3                                   # one batch per file
    assert led[-1].done == docs.count() and led[-1].percent == 100.0

    st = {r.sentiment: (r.n, round(r.avg_confidence, 6)) for r in spark.read.parquet(str(tmp_path / "stats")).collect()}
    from textlab.operators.stats import mean6
    bs = {r.sentiment: (r.n, round(r.a, 6)) for r in
          batch.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"), mean6("confidence").alias("a")).collect()}
    assert st == bs


def test_replayed_batch_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    SL._overwrite_key(df, str(tmp_path / "t"), 0)
    SL._overwrite_key(df, str(tmp_path / "t"), 0)          # replay of batch 0
    SL._overwrite_key(df.limit(1), str(tmp_path / "t"), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_post_files_stream(spark, tmp_path):
    from textlab.functions.scoring import lexicon_scorer
    from textlab.sources.store import load_view
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    head = "full_text,favorite_count,id_str,username\n"
    (inbox / "a.csv").write_text(head + '"bagus bagus",5,1,ann\n"buruk buruk",1000,2,bob\n')
    (inbox / "b.csv").write_text(head + '"biasa",,3,cy\n"",7,4,dee\n')
    out = str(tmp_path / "out")
    q = SL.label_posts_stream(spark, str(inbox), out, lexicon_scorer(["bagus"], ["buruk"]),
                              columns=["full_text", "favorite_count", "id_str", "username"],
                              checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    view = load_view(spark, out)
    got = sorted((r.text, r.sentiment, r.favorite_count) for r in view.collect())
    assert got == [("bagus bagus", "positive", 5), ("biasa", "neutral", 0), ("buruk buruk", "negative", 1000)]
    assert view.select("id").distinct().count() == 3                 # ids unique across batches
    led = spark.read.parquet(f"{out}/ledger")
    assert tuple(led.agg(F.sum("rows"), F.sum("saved"), F.sum("skipped")).first()) == (4, 3, 1)
    assert sorted(r.done for r in led.collect()) == [2, 4]


def test_posts_seen_before_are_dropped_within_the_watermark(spark, tmp_path):
    inbox = str(tmp_path / "in")
    rows = [[("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:05:00", 2), ("a", "2024-01-01 00:06:00", 3), (None, "2024-01-01 00:06:00", 4),
             (None, "2024-01-01 00:06:00", 5)],
            [("b", "2024-01-01 00:30:00", 6), ("c", "2024-01-01 00:31:00", 7), ("true", "2024-01-01 00:31:00", 8)],
            [("late", "2023-12-01 00:00:00", 9), ("c", "2024-01-01 01:00:00", 10), ("d", "2024-01-01 01:00:00", 11)]]
    schema = "id_str string, at string, n long"
    for k, part in enumerate(rows):
        df = spark.createDataFrame(part, schema).withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(inbox)
    src = SL.read_inbox(spark, inbox, df.schema)
    out = str(tmp_path / "out")

    def store(batch, batch_id):
        SL._overwrite_key(batch, out, batch_id)

    q = (SL.first_posts(src, "id_str", "at", "1 day").writeStream.foreachBatch(store).trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination()
    got = [(r.id_str, r.n) for r in spark.read.parquet(out).collect()]
    assert sorted(k for k, _ in got if k) == ["a", "b", "c", "d", "true"]        # one each; the one of December came too late
    assert sorted(n for k, n in got if k is None) == [4, 5]


def test_a_batch_shuffles_only_what_its_ids_can_join(spark):
    """Ids that repeat, lie apart or are null; static rows outside their range are not read on, and the rows are those of the whole tables."""
    from textlab.sources.tables import label_documents
    docs = spark.createDataFrame([(5, "a b", "x", "en"), (5, "c", "x", "en"), (9, None, None, None), (None, "n", "y", "en")],
                                 "doc_id long, text string, source string, lang string")
    vec = spark.createDataFrame([(k % 7, [float(k % 3), 0.5, 0.1]) for k in range(9)], "vec_id long, embedding array<float>")
    ev = spark.createDataFrame([(k, "error" if k == 6 else "view", k * 0.5, k) for k in [0, 5, 5, 6, 9, 50]],
                               "event_id long, event_type string, value double, user_id long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    cols = ["id", "text", "sentiment", "confidence", "favorite_count", "username", "source_dataset", "has_metadata"]
    far = sorted(tuple(r) for r in label_documents(docs, vec, ev).select(*cols).fillna("").collect())
    near = sorted(tuple(r) for r in label_documents(docs, vec, ev, near=True).select(*cols).fillna("").collect())
    by_hand = [(d, v, e) for d in (5, 5, 9) for v in range(9) if v % 7 == d % 9 for e in ([5, 5] if d == 5 else [9])]
    assert near == far and len(far) == len(by_hand) > 0
    plan = label_documents(docs, vec, ev, near=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" in plan and "<= 9" in plan and ">= 5" in plan
