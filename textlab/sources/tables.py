"""Driver tables and the canonical labelled input built from them.

``labeled`` stands in for the application's ``labeled_data_view``: documents paired with a class-score
vector (inner join, standing for texts x sentiments) and left-joined to an event (standing for
metadata). Everything is one lazy plan; Catalyst prunes the columns a query does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.scoring import classify, softmax
from textlab.functions.text import clean_text

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# class-score scale applied to the first three vector components
LOGIT_SCALE = 8.0


# text tables whose per-row work (regex cleaning, tokenising) dominates the scan
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; text tables with fewer splits than cores are spread (see :func:`spread`)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition a scan that has fewer input splits than the cluster has cores.

    A text table stored as one large row group is read by one task, and the regex work after it
    would run in that one task. Only then is it spread by ``key`` over the default parallelism; a
    table stored in many files (the normal case at scale) is returned untouched, with no shuffle.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def score_documents(docs: DataFrame, vectors: DataFrame, near: bool = False) -> DataFrame:
    """Pair each document with a class-score vector (``vec_id = doc_id mod |vectors|``) and classify it.

    The vector count is one number fetched before the plan runs (Parquet answers it from file
    footers). It is not a scalar subquery on purpose: plans that reuse this input twice (self-joins for
    offsets, streams) cannot run a subquery nested in an adaptive broadcast stage. The join is an
    equi-join on an expression key, so AQE picks broadcast only when the vector table is small enough
    and sort-merge otherwise. ``docs`` may be a streaming DataFrame (stream-static join).
    ``near`` as in :func:`label_documents`.
    """
    n_vec = F.lit(vectors.count())
    if near:
        vectors = _near(vectors, "vec_id", docs, F.pmod("doc_id", n_vec))
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * F.lit(LOGIT_SCALE))
    scores = vectors.select("vec_id", logits.alias("logits"))             # three numbers of a vector move, not all
    dv = docs.join(scores, F.pmod(docs["doc_id"], n_vec) == scores["vec_id"], "inner")
    out = dv.select(docs["doc_id"].alias("id"), "text", F.col("source").alias("source_dataset"), "lang", "logits")
    return _classified(out)


def _near(static: DataFrame, key: str, docs: DataFrame, wanted: Column) -> DataFrame:
    """Rows of ``static`` with a ``key`` from the least to the largest value ``wanted`` of ``docs``: all that can join."""
    low, high = docs.agg(F.min(wanted), F.max(wanted)).first()
    return static.filter(F.lit(False) if low is None else F.col(key).between(low, high))


def _classified(df: DataFrame) -> DataFrame:
    out = df.withColumn("probs", softmax("logits"))
    cls = classify("probs")
    return out.withColumn("sentiment", cls["sentiment"]).withColumn("confidence", F.round(cls["confidence"], 6))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents JOIN embeddings with logits, probabilities, sentiment and confidence."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


def label_documents(docs: DataFrame, vectors: DataFrame, events: DataFrame, near: bool = False) -> DataFrame:
    """The canonical labelled record for ``docs`` (batch or streaming): scored, cleaned, with metadata.

    A batch is joined by its ids first, and the result with the documents by id, so a text is moved once, and past a hash
    table instead of being sorted. An id that occurs several times in any of the tables gives as many rows as direct joins.
    With ``near`` (a batch only) its least and largest id are found first, and of the other tables only rows between are read
    on: for a small part of the documents whose ids lie together. The rows are the same for any ids.
    """
    e = (events.filter(F.col("event_type") != "error")
         .select("event_id", "ts", "user_id", "event_type", "value"))
    if docs.isStreaming:
        s = score_documents(docs, vectors)
        j = s.join(e, s["id"] == e["event_id"], "left")
    else:
        ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
        bare = ids.withColumns({"text": F.lit(None), "source": F.lit(None), "lang": F.lit(None)})
        if near:
            e = _near(e, "event_id", docs, F.col("doc_id"))
        found = score_documents(bare, vectors, near).select(F.col("id").alias("own_id"), "logits")
        found = found.join(e, found["own_id"] == e["event_id"], "left")
        d = docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_dataset"), "lang")
        j = _classified(d.join(found.hint("shuffle_hash"), d["id"] == found["own_id"]).drop("own_id"))
    return j.select(
        "id", "text", clean_text("text").alias("preprocessed_text"), "sentiment", "confidence",
        F.floor(F.col("value") * 10).cast("int").alias("favorite_count"),
        F.col("ts").alias("created_at"), F.col("event_type").alias("location"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        "source_dataset", "lang", "logits", "probs",
        F.col("event_id").isNotNull().alias("has_metadata"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical labelled record (10 view columns plus ``logits``/``probs``/``lang``)."""
    return label_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"),
                           table(spark, sf_dir, "events"))


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``texts``, ``sentiments`` and ``metadata``, each from the tables it needs and no others.

    ``sentiments`` are the scored documents, ``texts`` the documents with the time of their event, ``metadata`` the
    events of documents.
    """
    docs = table(spark, sf_dir, "documents")
    events = read_events(spark, sf_dir)
    texts = docs.join(events.select("event_id", "ts"), docs["doc_id"] == events["event_id"], "left").select(
        F.col("doc_id").alias("id"), "text", clean_text("text").alias("preprocessed_text"), F.col("ts").alias("created_at"),
        F.col("source").alias("source_dataset"))
    sentiments = scored_documents(spark, sf_dir).select(F.col("id").alias("text_id"), "sentiment", "confidence")
    ids = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id")
    metadata = events.join(ids, events["event_id"] == ids["doc_id"], "left_semi").select(
        F.col("event_id").alias("text_id"), F.floor(F.col("value") * 10).cast("int").alias("favorite_count"),
        F.col("event_type").alias("location"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"))
    return {"texts": texts, "sentiments": sentiments, "metadata": metadata}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that stand for metadata (errors left out)."""
    return table(spark, sf_dir, "events").filter(F.col("event_type") != "error").select(
        "event_id", "ts", "user_id", "event_type", "value")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference labels: toxic -> negative, else quality -> positive, else neutral."""
    lb = table(spark, sf_dir, "labels")
    return lb.select(F.col("doc_id").alias("id"),
                     F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
                     .otherwise("neutral").alias("actual"))
