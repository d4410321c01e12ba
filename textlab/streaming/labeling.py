"""Label files as they arrive (G1), keep running sentiment statistics (G2) and a per-batch ledger.

The application reported a finite file in pieces; here the same work is a Structured Streaming job:
a file source over an inbox folder (``maxFilesPerTrigger`` sets the batch size), a stream-static join
with the class-score vectors and the metadata, and a ``foreachBatch`` sink. Every write of a batch is
keyed by its batch id and overwrites only that key, so a batch replayed after a failure (the
checkpoint records it as not committed) writes the same rows again instead of adding duplicates.
The checkpoint and all outputs live under the shared checkpoint folder of the session.

``label_stream`` joins the documents with static tables (the class-score vectors and the event table
that stand for the metadata in the driver's data). On a stream each micro-batch shuffles the whole static sides; on one
batch inside ``run_labeling`` and ``run_scoring`` only those of its range of ids. ``label_posts_stream`` is the form for post files, which
carry their own metadata columns and need no static join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.rules import apply_rules
from textlab.sources.scratch import scratch_path, temporary
from textlab.sources.tables import label_documents


def stage_inbox(docs: DataFrame, path: str, n_files: int = 4, key: str = "doc_id") -> str:
    """Write ``docs`` as ``n_files`` Parquet files (by key range) into ``path``, standing for arrivals."""
    docs.repartitionByRange(n_files, key).write.mode("overwrite").parquet(path)
    return path


def read_inbox(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Streaming source over the inbox; the schema is fixed up front (no inference on a stream)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def label_stream(stream_docs: DataFrame, vectors: DataFrame, events: DataFrame,
                 conf_rules: list[tuple[str, float, str]] | None = None) -> DataFrame:
    """G1: the batch labelling plan applied to a stream, or to one of its batches (clean, score, metadata, rules)."""
    lab = label_documents(stream_docs, vectors, events, near=not stream_docs.isStreaming)
    if conf_rules is not None:
        lab = apply_rules(lab, conf_rules, {}, None)
    return lab


def running_stats(labeled_stream: DataFrame) -> DataFrame:
    """Rows and mean confidence per sentiment, updated with every batch (complete output).

    The mean is exact to 6 decimals whatever the batch split (integer micro-unit sums).
    """
    from textlab.operators.stats import mean6
    return labeled_stream.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"),
                                                   mean6("confidence").alias("avg_confidence"))


def _overwrite_key(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch's rows under ``batch_id=<id>``, replacing only that partition."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write
       .option("partitionOverwriteMode", "dynamic").mode("overwrite")
       .partitionBy("batch_id").parquet(path))


def first_posts(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """A stream of posts without those whose ``key`` came before, within ``delay`` of event time.

    State is one entry per key of the last ``delay``, dropped as the watermark passes, so it does not grow with the stream.
    Rows without a key are told apart by all their columns. Rows later than the watermark are dropped, as Spark does.
    """
    name = "_post_key"
    whole = F.xxhash64(*[F.col(c) for c in stream.columns])
    keyed = stream.withColumn(name, F.when(F.col(key).isNotNull(), F.struct(F.lit(True).alias("own"), F.xxhash64(key).alias("h"),
                                                                            F.col(key).cast("string").alias("k")))
                              .otherwise(F.struct(F.lit(False).alias("own"), whole.alias("h"), F.lit("").alias("k"))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark([name]).drop(name)


def _done_before(spark: SparkSession, ledger: str, batch_id: int) -> int:
    """Rows of all batches before ``batch_id``: what the batch before it has as ``done``, read from its own folder."""
    from textlab.sources.store import path_exists
    before = f"{ledger}={batch_id - 1}"
    if not path_exists(spark, before):
        return 0
    return spark.read.parquet(before).agg(F.max("done")).first()[0] or 0


def _adaptive(batch: DataFrame) -> DataFrame:
    """Turns adaptive plans on for what is made of a batch: a stream's own session has them off, for the sake of its state."""
    batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return batch


def run_labeling(spark: SparkSession, labeled_stream: DataFrame, out: str, checkpoint: str | None = None,
                 available_now: bool = True, label=None):
    """G1 + G3: store labelled rows per batch and append a ledger row ``(batch_id, rows, saved, skipped, done)``,
    ``done`` being the rows of all batches so far: each batch adds its own to those of the one before.

    ``saved`` are rows with text to score, ``skipped`` rows without (F2); the two counts come from one
    aggregate over the batch, which is persisted so the batch is read once for both writes.
    ``label``, a function of one batch, makes the labelled rows of a stream that has none yet (see :func:`label_stream`).
    Returns the finished (``availableNow``) or running query.
    """
    checkpoint = checkpoint or scratch_path(spark, "label-stream-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = (label(_adaptive(batch)) if label else batch).persist()
        try:
            ok = F.col("text").isNotNull() & (F.col("text") != "")
            _overwrite_key(batch.filter(ok), f"{out}/labeled", batch_id)
            ledger = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("saved"),
                               F.count_if(~ok | F.col("text").isNull()).alias("skipped"))
            ledger = ledger.withColumn("done", F.col("rows") + _done_before(spark, f"{out}/ledger/batch_id", batch_id))
            _overwrite_key(ledger, f"{out}/ledger", batch_id)
        finally:
            batch.unpersist()

    w = labeled_stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_scoring(spark: SparkSession, stream: DataFrame, out: str, label, columns: list[str], checkpoint: str | None = None,
                available_now: bool = True):
    """The ``columns`` of ``label(batch)`` of every batch, a file a batch under ``out``, to be read as a stream by what keeps
    running figures. Such a stream is started once this one has ended: a batch that is replayed replaces its file."""
    checkpoint = checkpoint or scratch_path(spark, "score-stream-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        label(_adaptive(batch)).select(*columns).repartition(1).write.mode("overwrite").parquet(f"{out}/batch-{batch_id:09d}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_running_stats(spark: SparkSession, stats_stream: DataFrame, out: str, checkpoint: str | None = None,
                      available_now: bool = True):
    """G2 sink: each batch's complete aggregate replaces the result table (small: one row per class)."""
    checkpoint = checkpoint or scratch_path(spark, "stats-stream-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(out)

    w = (stats_stream.writeStream.outputMode("complete").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def batch_ledger(spark: SparkSession, out: str) -> DataFrame:
    """The ledger with cumulative progress: rows done so far and percent of rows seen so far."""
    led = spark.read.parquet(f"{out}/ledger")
    total = led.select(F.max("done")).scalar()
    return led.select("batch_id", "rows", "saved", "skipped", "done", F.round(F.col("done") * 100.0 / total, 1).alias("percent"))


def label_posts_stream(spark: SparkSession, inbox: str, out: str, make_scorer, rules: DataFrame | None = None,
                       columns: list[str] | None = None, files_per_trigger: int = 1, checkpoint: str | None = None,
                       available_now: bool = True):
    """G1 for post files: CSV files arriving in ``inbox`` are labelled per micro-batch with the batch plan
    (:func:`textlab.plans.labelling.label_frame`: checks, clean, score once, rules, three tables).

    The stream is one of file names, at most ``files_per_trigger`` a batch; a batch reads its files as the batch job does,
    each by the names of its own header and in its own encoding (``columns`` replaces the names). A file without a
    ``full_text`` column, or that cannot be read, stops the stream with its error.

    Batch ``k`` is stored under ``out/{texts,sentiments,metadata}/batch=k`` with ids from ``k * 2^32 + 1``,
    and its counts under ``out/ledger/batch=k``; a replayed batch overwrites exactly its own folders.
    The posts carry their own metadata columns, so no static table is joined per batch.
    """
    from textlab.plans.labelling import label_frame
    from textlab.sources import posts as P
    # a binary-file scan reads no content when only paths are taken
    src = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
           .option("pathGlobFilter", "*.csv")
           .option("maxFilesPerTrigger", files_per_trigger).load(inbox).select("path"))
    checkpoint = checkpoint or scratch_path(spark, "posts-stream-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r["path"] for r in batch.collect())       # file names, of one batch
        with temporary(spark):                       # the batch's own tables go once it is stored
            res = label_frame(spark, P.parse_posts(spark, files, columns), out, make_scorer, rules, id_start=(batch_id << 32) + 1,
                              partition=f"batch={batch_id}")
            done = F.col("rows") + _done_before(spark, f"{out}/ledger/batch", batch_id)
            res.progress.withColumn("done", done).write.mode("overwrite").parquet(f"{out}/ledger/batch={batch_id}")

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
