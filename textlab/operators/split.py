"""Reproducible train/test split and its summaries (W1, W2, W4, A8-A10, K5 layout).

The split is an exact prefix of a seeded hash order, found without sorting or ranking the rows: counts per
leading hex digits select the cut, and rows are compared with it. Positions in key order (W4) come from buckets
whose sizes are summed into offsets on the small bucket table, each bucket being ranked on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab import schema as S
from textlab.operators.stats import pct1
from textlab.sources.posts import check_percent


def seeded_key(id_col: str = "id", seed: int = S.SPLIT_SEED) -> Column:
    """Deterministic shuffle key: md5 of ``'<seed>:<id>'``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def dense_index(df: DataFrame, bucket: Column, order: list[Column], out: str = "row_idx") -> DataFrame:
    """0-based position of every row in the total order ``(bucket, *order)``.

    ``bucket`` must be monotone with the order and should spread rows evenly (e.g. hash digits).
    The bucket table is bounded by the number of buckets, so it is broadcast; the rank runs per bucket.
    Adds ``_n_total`` (row count) as well.
    """
    b = df.withColumn("_bk", bucket)
    counts = b.groupBy("_bk").agg(F.count(F.lit(1)).alias("_bn"))
    wcum = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_bk", F.coalesce(F.sum("_bn").over(wcum), F.lit(0)).alias("_off"),
                         F.sum("_bn").over(Window.partitionBy()).alias("_n_total"))
    j = b.join(F.broadcast(offs), "_bk")
    w = Window.partitionBy("_bk").orderBy(*order)
    return j.withColumn(out, F.col("_off") + F.row_number().over(w) - 1).drop("_bk", "_off")


def key_order_index(df: DataFrame, key: str, out: str = "row_idx", n_buckets: int = 4096) -> DataFrame:
    """0-based position of every row in ``key`` order, skew-proof: the key is cut at ``n_buckets - 1``
    approximate quantiles (a bounded list on the driver; ``Bucketizer`` does the binary search), so
    every range holds about ``n / n_buckets`` rows however the keys are spread, then
    :func:`dense_index` ranks inside the ranges. Rows with a null key come last; without any key
    (no rows, or nulls only) there is one range. Adds ``_n_total``."""
    from pyspark.ml.feature import Bucketizer
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.approxQuantile(key, probs, 1.0 / (4 * n_buckets)) if n_buckets > 1 else []
    if not cuts:
        return dense_index(df, F.col(key).isNull().cast("int"), [F.col(key)], out=out)
    splits = [float("-inf")] + sorted(set(float(c) for c in cuts)) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_key_d", outputCol="_range", handleInvalid="keep")
    x = b.transform(df.withColumn("_key_d", F.col(key).cast("double")))
    return dense_index(x, F.coalesce(F.col("_range").cast("int"), F.lit(len(splits))), [F.col(key)],
                       out=out).drop("_key_d", "_range")


#: Rows that are ordered to find the cut itself, once all rows of other hash prefixes are decided.
CUT_ROWS = 10_000
HEX_STEP, HEX_ALL = 4, 32


def cut_of(keyed: DataFrame, n_train: int, id_col: str) -> tuple | None:
    """(key, id) of the ``n_train``-th row in the order (``_key``, id), by radix selection; None for no row.

    Counts per hash prefix (16^4 at most) decide all prefixes but one, which is looked at with four digits more; once
    few rows share the prefix, or their whole key, the cut is one of a bounded top-k.
    """
    prefix, wanted, left = "", n_train, None
    while n_train > 0:
        inside = keyed.filter(F.col("_key").startswith(prefix)) if prefix else keyed
        if (left is not None and left <= CUT_ROWS) or len(prefix) >= HEX_ALL:
            rows = inside.select("_key", F.col(id_col).alias("_id")).orderBy("_key", "_id").limit(wanted).collect()
            return rows[-1]["_key"], rows[-1]["_id"]
        parts = inside.groupBy(F.substring("_key", len(prefix) + 1, HEX_STEP).alias("d")).count().collect()
        for d, n in sorted((r["d"], r["count"]) for r in parts):
            if wanted <= n:
                prefix, left = prefix + d, n
                break
            wanted -= n
    return None


def train_test_split(df: DataFrame, id_col: str = "id", train_percent: float = S.DEFAULT_TRAIN_PERCENT,
                     seed: int = S.SPLIT_SEED) -> DataFrame:
    """Permute by the seeded key, the first ``floor(n * p / 100)`` rows are train, the rest test.

    Adds ``split_type``. The cut is selected (:func:`cut_of`) and every row is compared with it: no row is ranked or
    moved. Rows of equal ids lie on the same side; rows without an id count as the first of all.
    """
    train_percent = check_percent(train_percent)
    key = F.coalesce(seeded_key(id_col, seed), F.lit("0" * HEX_ALL))
    keyed = df.select(key.alias("_key"), F.col(id_col))
    cut = cut_of(keyed, math.floor(keyed.count() * train_percent / 100.0), id_col)
    if cut is None:
        return df.withColumn("split_type", F.lit("test"))
    at, own = cut
    same_key = F.col(id_col).isNull() if own is None else F.col(id_col).isNull() | (F.col(id_col) <= F.lit(own))
    first = (key < at) | ((key == at) & same_key)
    return df.withColumn("split_type", F.when(first, "train").otherwise("test"))


def split_preview(df: DataFrame, train_percent: float) -> DataFrame:
    """Preview sizes with half-even rounding (so 7 rows at 50 % give 4 train) and effective percents (the requested ones for no rows)."""
    c = df.agg(F.count(F.lit(1)).alias("total_rows"))
    train = F.bround(F.col("total_rows") * F.lit(float(train_percent)) / 100.0, 0).cast("bigint")
    c = c.withColumn("train_rows", train).withColumn("test_rows", F.col("total_rows") - F.col("train_rows"))
    tp = F.when(F.col("total_rows") > 0, F.col("train_rows") / F.col("total_rows") * 100).otherwise(F.lit(float(train_percent)))
    sp = F.when(F.col("total_rows") > 0, F.col("test_rows") / F.col("total_rows") * 100).otherwise(F.lit(100.0 - float(train_percent)))
    return c.select("total_rows", "train_rows", "test_rows", F.round(tp, 6).alias("train_percent"),
                    F.round(sp, 6).alias("test_percent"))


def split_summary(texts: DataFrame, splits: DataFrame) -> DataFrame:
    """Total texts and train/test counts (one pass over each table, one-row results)."""
    t = texts.agg(F.count(F.lit(1)).alias("total_data"))
    s = splits.agg(F.count_if(F.col("split_type") == "train").alias("train_data"),
                   F.count_if(F.col("split_type") == "test").alias("test_data"))
    return t.withColumn("_k", F.lit(1)).join(s.withColumn("_k", F.lit(1)), "_k").drop("_k")


def data_distribution(summary: DataFrame) -> DataFrame:
    """A10: reconcile the summary (no split -> all train; clamp the untrusted side at >= 0), percents to 1 dp."""
    tot, tr, te = F.col("total_data"), F.col("train_data"), F.col("test_data")
    no_split = (tot > 0) & (tr == 0) & (te == 0)
    tr1 = F.when(no_split, tot).otherwise(tr)
    te1 = F.when(no_split, F.lit(0)).otherwise(te)
    x = summary.select(tot.alias("total_data"), tr1.alias("tr"), te1.alias("te"))
    over = (F.col("tr") + F.col("te")) > F.col("total_data")
    tr2 = F.when(over & (F.col("te") > 0), F.greatest(F.col("total_data") - F.col("te"), F.lit(0))).otherwise(F.col("tr"))
    te2 = (F.when(over & ~(F.col("te") > 0) & (F.col("tr") > 0), F.greatest(F.col("total_data") - F.col("tr"), F.lit(0)))
           .otherwise(F.col("te")))
    x = x.select("total_data", tr2.cast("bigint").alias("train_size"), te2.cast("bigint").alias("test_size"))
    return x.select("total_data", "train_size", "test_size",
                    pct1(F.col("train_size"), F.col("total_data")).alias("train_percent"),
                    pct1(F.col("test_size"), F.col("total_data")).alias("test_percent"))


def batch_size_for(n: Column, cap: int = 50, floor_size: int = 10) -> Column:
    """``min(cap, max(10, n // 20))``."""
    return F.least(F.lit(cap), F.greatest(F.lit(floor_size), F.floor(n / 20))).cast("bigint")


def batch_progress(df: DataFrame, id_col: str = "id", text_col: str = "text", cap: int = 50) -> DataFrame:
    """W4 + A21 + G3: the per-batch ledger of the labelling loop (rows, saved, skipped, done, progress).

    Batches are contiguous in id order; the position is :func:`key_order_index` (quantile ranges, so
    no range grows with key skew), and ``done``/``progress`` follow arithmetically from the batch
    number (no running window).
    """
    x = key_order_index(df, id_col)
    size = batch_size_for(F.col("_n_total"), cap)
    x = x.withColumn("batch", F.floor(F.col("row_idx") / size).cast("bigint")).withColumn("_size", size)
    ok = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    g = x.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_saved"),
                               F.first("_size").alias("batch_size"), F.first("_n_total").alias("total_rows"))
    start = F.col("batch") * F.col("batch_size")
    return g.select("batch", "n_rows", "n_saved", (F.col("n_rows") - F.col("n_saved")).alias("n_skipped"),
                    F.least(start + F.col("batch_size"), F.col("total_rows")).alias("done"),
                    F.floor(start / F.col("total_rows") * 80).cast("int").alias("progress"))


def test_distribution(spark, test_df: DataFrame) -> DataFrame:
    """Test-set sentiment counts over the fixed domain, total, percent rounded half-even to 1 dp."""
    from textlab.operators.stats import domain
    counts = test_df.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
    j = domain(spark).join(counts, "sentiment", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    total = F.sum(n).over(Window.partitionBy())
    return j.select("sentiment", n.alias("n"), total.alias("total"), pct1(n, total).alias("pct"))
