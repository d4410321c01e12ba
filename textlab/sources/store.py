"""Stored tables (K2-K7, S4, S8, S10, F1, F11): the normalised layout behind one joined view.

Layout under a base folder: ``texts/``, ``sentiments/``, ``metadata/`` (Parquet), ``dataset_splits/``
partitioned by ``split_type``, ``rules/`` partitioned by ``rule_type``, ``models/<name>/<version>``
plus a ``registry/`` table. Writes never overwrite a folder that is being read: new data goes to a
new version folder.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab import schema as S
from textlab.functions.dates import format_created_at


def allocate_ids(df: DataFrame, natural_key: str, start: int = 1, out: str = "text_id",
                 n_buckets: int = 4096) -> DataFrame:
    """K3 id allocation: dense ids ``start..start+n-1`` in natural-key order.

    Deterministic (a recomputation gives the same ids) and distributed: rows are cut into key ranges
    at approximate quantiles of the key (``n_buckets`` boundaries, a bounded list), so every range holds
    about ``n / n_buckets`` rows however the keys are spread; range sizes are summed into offsets on
    the small range table and each range is ranked on its own (see
    :func:`textlab.operators.split.dense_index`). The range lookup is ``Bucketizer``'s binary search.
    """
    from textlab.operators.split import key_order_index
    x = key_order_index(df, natural_key, out="_idx", n_buckets=n_buckets)
    return x.withColumn(out, (F.col("_idx") + F.lit(start)).cast("bigint")).drop("_idx", "_n_total")


def save_labeled(spark: SparkSession, df: DataFrame, base: str, natural_key: str = "id",
                 mode: str = "overwrite", id_start: int | None = None, partition: str | None = None,
                 row: str | None = None) -> dict[str, str]:
    """K3 / K4: store labelled records as three tables sharing one allocated ``text_id``.

    Ids are dense from ``id_start``; unless given, that is 1, or with ``mode='append'`` one above the largest stored id.
    Appends to one store must not run at the same time.

    The id allocation is materialised once (a Parquet table in the shared checkpoint folder), so
    the three writes cannot see different ids even if a task is recomputed after executor loss. It runs on keys alone, and
    a text moves once, to its id, past a hash table. ``row`` names a number that tells the rows of a stored ``df`` apart;
    without it ``df`` is written once with such a number.
    Rows without metadata (``has_metadata`` false, when the column exists) get no metadata row. A ``created_at`` that is
    still text is read by the store's rule (T10): with a day name as a social-media date, else as an ISO time, else null.
    """
    from textlab.sources.scratch import materialize
    if dict(df.dtypes)["created_at"] == "string":
        df = df.withColumn("created_at", format_created_at("created_at").try_cast("timestamp_ntz"))
    if id_start is None:
        id_start = next_id(spark, base) if mode == "append" else 1
    if row is None:
        row = "_store_row"
        df = materialize(df.withColumn(row, F.monotonically_increasing_id()), "rows-to-store")
    keys = df.select(row, F.col(natural_key).alias("_key"))
    ids = materialize(allocate_ids(keys, "_key", start=id_start).select(row, "text_id"), "allocated-ids")
    x = df.join(ids.hint("shuffle_hash"), row)
    has_meta = F.col("has_metadata") if "has_metadata" in df.columns else F.lit(True)
    sub = f"/{partition}" if partition else ""            # e.g. "batch=7": one folder per stream batch
    paths = {t: f"{base.rstrip('/')}/{t}{sub}" for t in ("texts", "sentiments", "metadata")}
    x.select(F.col("text_id").alias("id"), "text", "preprocessed_text", "created_at", "source_dataset") \
        .write.mode(mode).parquet(paths["texts"])
    x.select(F.col("text_id").alias("id"), "text_id", "sentiment", "confidence") \
        .write.mode(mode).parquet(paths["sentiments"])
    x.filter(has_meta).select(F.col("text_id").alias("id"), "text_id",
                              F.coalesce("favorite_count", F.lit(0)).alias("favorite_count"), "location", "username") \
        .write.mode(mode).parquet(paths["metadata"])
    return paths


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists in its file system (any that Spark reads)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def next_id(spark: SparkSession, base: str) -> int:
    """One above the largest stored text id (1 for an absent or empty store)."""
    path = f"{base.rstrip('/')}/texts"
    if not path_exists(spark, path):
        return 1
    return (spark.read.parquet(path).agg(F.max("id")).first()[0] or 0) + 1


def load_view(spark: SparkSession, base: str) -> DataFrame:
    """The joined view over stored tables (inner to sentiments, left to metadata)."""
    t = spark.read.parquet(f"{base}/texts")
    s = spark.read.parquet(f"{base}/sentiments").select("text_id", "sentiment", "confidence")
    m = spark.read.parquet(f"{base}/metadata").select("text_id", "favorite_count", "location", "username")
    j = t.join(s, t["id"] == s["text_id"]).join(m, t["id"] == m["text_id"], "left")
    return j.select(t["id"], "text", "preprocessed_text", "sentiment", "confidence", "favorite_count",
                    "created_at", "location", "username", "source_dataset")


def fetch_all(view: DataFrame, limit: int | None = None) -> DataFrame:
    """The view, optionally the first ``limit`` rows by id (0 or None = no limit)."""
    return view.orderBy("id").limit(limit) if limit else view


def by_sentiment(view: DataFrame, sentiment: str) -> DataFrame:
    """rows of one sentiment (pushed down to the scan as a filter)."""
    return view.filter(F.col("sentiment") == sentiment)


def export_csv(view: DataFrame, path: str) -> bool:
    """K2: the whole view to CSV (written by the executors, one file per partition)."""
    from textlab.sources.posts import write_csv
    write_csv(view, path)
    return True


def save_dataset_splits(splits: DataFrame, path: str) -> None:
    """K5: replace the split table; one folder per split type (partition pruning on read)."""
    splits.select("text_id", "split_type").write.mode("overwrite").partitionBy("split_type").parquet(path)


def load_split(spark: SparkSession, view: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """View rows of the train and of the test split (each read prunes to its partition)."""
    sp = spark.read.parquet(path)
    out = []
    for which in S.SPLIT_TYPES:
        s = sp.filter(F.col("split_type") == which)
        out.append(view.join(s, view["id"] == s["text_id"], "inner").drop("text_id"))
    return out[0], out[1]


def save_rules(rules: DataFrame, path: str) -> None:
    """K6: replace only the rule types present in ``rules`` (dynamic partition overwrite)."""
    from textlab.operators.rules import rules_to_json
    (rules_to_json(rules).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy("rule_type").parquet(path))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """The four known rule groups, parsed, ordered by ordinal."""
    from textlab.operators.rules import rules_from_json
    return rules_from_json(spark.read.parquet(path)).orderBy("rule_type", "ordinal")


def model_name(now: _dt.datetime | None = None) -> str:
    """``sentiment_model_YYYYmmdd_HHMMSS``."""
    return S.MODEL_NAME_PREFIX + (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")


def save_model(spark: SparkSession, base: str, name: str, model, accuracy: float | None) -> str:
    """K7: persist a fitted ML model under a new version folder and upsert the registry row by name.

    The registry is rewritten as a new version (left-anti the old row, union the new one); the newest
    version with a success mark is the current one, so readers never see a half-written folder.
    """
    import uuid
    ver = uuid.uuid4().hex[:12]
    mpath = f"{base}/models/{name}/{ver}"
    model.write().overwrite().save(mpath)
    row = spark.createDataFrame([(name, mpath, accuracy, _dt.datetime.now())], S.MODEL_REGISTRY)
    reg_root = f"{base}/registry"
    cur = _current_registry(spark, reg_root)
    new = row if cur is None else cur.join(row.select("model_name"), "model_name", "left_anti").unionByName(row)
    new.write.mode("errorifexists").parquet(f"{reg_root}/v-{len(_versions(spark, reg_root)):09d}-{ver}")
    return mpath


def _versions(spark: SparkSession, reg_root: str) -> list[str]:
    """Complete registry versions, oldest first (a version counts once Spark has written its success mark)."""
    if not path_exists(spark, reg_root):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(reg_root)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    paths = sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("v-"))
    return [p for p in paths if path_exists(spark, f"{p}/_SUCCESS")]


def _current_registry(spark: SparkSession, reg_root: str):
    """The newest complete registry version, None before the first; read errors are raised."""
    found = _versions(spark, reg_root)
    return spark.read.parquet(found[-1]) if found else None


def get_model(spark: SparkSession, base: str, name: str):
    """``(model, accuracy)`` for a name, or None when absent."""
    from pyspark.ml import PipelineModel
    reg = _current_registry(spark, f"{base}/registry")
    if reg is None:
        return None
    r = reg.filter(F.col("model_name") == name).select("path", "accuracy").first()
    if r is None:
        return None
    return PipelineModel.load(r[0]), r[1]


def execute_query(spark: SparkSession, query: str, params: list | dict | None = None,
                  views: dict[str, DataFrame] | None = None) -> DataFrame:
    """A parameterised SQL statement over named views (positional ``?`` or named ``:x`` markers)."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=params) if params else spark.sql(query)
