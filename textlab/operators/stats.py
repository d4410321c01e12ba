"""Statistics over the labelled data (A1-A15, A21-A22): counts, shares, means, histogram, box plot.

All are partial/final hash aggregations; results are a handful of rows. Zero-filling joins the
counts with the fixed label domain (three rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab import schema as S
from textlab.sources.scratch import materialize


def domain(spark: SparkSession, values: list[str] = S.SENTIMENTS, name: str = "sentiment") -> DataFrame:
    """The fixed label domain as a one-column literal table (zero-fill side)."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"dom_ord int, {name} string")


def sentiment_counts(df: DataFrame) -> DataFrame:
    """A1 / L4: rows per sentiment, by count descending."""
    return df.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sentiment")


def dataset_counts(df: DataFrame) -> DataFrame:
    """A2 / L4: rows per source dataset, by count descending."""
    return df.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_dataset")


def mean6(col: str) -> Column:
    """Mean of a 6-decimal column, rounded to 6 decimals, independent of summation order.

    Values are summed as exact integer micro-units (one integer division afterwards), so the result
    does not depend on how rows are split over tasks or micro-batches: a plain ``avg`` of doubles
    can flip the 6th decimal at a rounding boundary between two runs.
    """
    micro = F.sum(F.round(F.col(col) * 1_000_000).cast("long"))
    return F.round(micro / F.count(col)) / 1_000_000.0


def sentiment_stats(texts: DataFrame, sentiments: DataFrame, metadata: DataFrame) -> DataFrame:
    """A3: totals and means over the base tables (AVG skips nulls), one row.

    Three independent single-row aggregates (each scan is combined map-side), joined on a constant
    key: equi-joins of one-row sides, never a cartesian product.
    """
    t = texts.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))
    s = sentiments.agg(mean6("confidence").alias("avg_confidence")).withColumn("_k", F.lit(1))
    m = metadata.agg(F.avg("favorite_count").alias("avg_favorite_count")).withColumn("_k", F.lit(1))
    return (t.join(s, "_k").join(m, "_k")
             .select("total", F.round("avg_confidence", 6).alias("avg_confidence"),
                     F.round("avg_favorite_count", 6).alias("avg_favorite_count")))


def stats_grouping_sets(df: DataFrame) -> DataFrame:
    """A4 in one scan: counts and mean confidence by sentiment, by source and in total (grouping sets)."""
    return (df.groupingSets([["sentiment"], ["source_dataset"], []], "sentiment", "source_dataset")
              .agg(F.grouping_id("sentiment", "source_dataset").cast("int").alias("gid"),
                   F.count(F.lit(1)).alias("n"), mean6("confidence").alias("avg_confidence")))


def dashboard_stats(df: DataFrame) -> DataFrame:
    """A5: one row with total, per-sentiment counts (fixed domain, zero when absent) and means."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in S.SENTIMENTS]
    aggs += [mean6("confidence").alias("avg_confidence"),
             F.round(F.avg("favorite_count"), 6).alias("avg_likes")]
    return df.agg(*aggs)


def sentiment_distribution(spark: SparkSession, df: DataFrame, pct_decimals: int | None = None) -> DataFrame:
    """A6 + A7: zero-filled counts over the fixed domain with percentage of the total."""
    return _distribution(spark, df.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n")), pct_decimals)


def distribution_of_counts(spark: SparkSession, counts: dict[str, int], pct_decimals: int | None = None) -> DataFrame:
    """As :func:`sentiment_distribution`, of counts that are known already."""
    return _distribution(spark, spark.createDataFrame(list(counts.items()), "sentiment string, n long"), pct_decimals)


def _distribution(spark: SparkSession, counts: DataFrame, pct_decimals: int | None) -> DataFrame:
    j = domain(spark).join(counts, "sentiment", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    total = F.sum(n).over(_all())
    pct = F.when(total > 0, n * 100.0 / total).otherwise(F.lit(0.0))
    pct = F.bround(pct, pct_decimals) if pct_decimals is not None else F.round(pct, 6)
    return j.select("sentiment", n.alias("n"), pct.alias("pct"), total.alias("total"))


def _all():
    from pyspark.sql import Window
    return Window.partitionBy()


def confidence_histogram(df: DataFrame, col: str = "confidence", bins: int = S.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram between min and max; the maximum folds into the last bin.

    min and max are scalar subqueries (one aggregate pass), not a driver round trip.
    """
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    x = F.col(col)
    width = hi - lo
    b = F.when(width > 0, F.least(F.floor((x - lo) / width * bins).cast("int") + 1, F.lit(bins))).otherwise(F.lit(1))
    return (df.filter(x.isNotNull()).groupBy(b.alias("bucket"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select("bucket", "n",
                      F.round(lo + (F.col("bucket") - 1) * width / bins, 6).alias("lo"),
                      F.round(lo + F.col("bucket") * width / bins, 6).alias("hi")))


#: Parts that an interval is cut into per step of the selection, and distinct values that are ordered at its end.
SELECT_PARTS, SELECT_VALUES = 1024, 10_000


def order_statistics(values: DataFrame, wanted: dict) -> dict:
    """{(group, rank): value} of 0-based ranks per group, by selection: ``values`` (g, v double, n), n being a value's count.

    Every wanted rank has an interval of values. A step counts the parts of all intervals in one aggregate and keeps the
    part that holds the rank; a part with few distinct values is ordered (bounded), one with a single value is the answer.
    """
    spark, found = values.sparkSession, {}
    ends = {r["g"]: (r["lo"], r["hi"]) for r in values.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    todo = {(g, k): (*ends[g], k) for g, ranks in wanted.items() for k in ranks}      # interval, rank inside it
    kind = values.schema["g"].dataType.simpleString()
    while todo:
        spans = sorted({(g, lo, hi) for (g, _), (lo, hi, _) in todo.items()}, key=str)
        table = F.broadcast(spark.createDataFrame(spans, f"sg {kind}, lo double, hi double"))     # groups x ranks rows
        inside = values.join(table, F.col("g").eqNullSafe(F.col("sg")) & F.col("v").between(F.col("lo"), F.col("hi")))
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * SELECT_PARTS), F.lit(SELECT_PARTS - 1))).otherwise(F.lit(0))
        counts = (inside.groupBy("sg", "lo", "hi", part.alias("part"))
                  .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("v").alias("a"), F.max("v").alias("b")).collect())
        cells: dict = {}
        for r in sorted(counts, key=lambda r: r["part"]):
            cells.setdefault((r["sg"], r["lo"], r["hi"]), []).append(r)
        small, rest = {}, {}
        for (g, k), (lo, hi, rank) in todo.items():
            for r in cells[(g, lo, hi)]:
                if rank < r["n"]:
                    break
                rank -= r["n"]
            if r["a"] == r["b"]:
                found[(g, k)] = r["a"]
            elif r["d"] <= SELECT_VALUES:
                small[(g, k)] = (r["a"], r["b"], rank)
            else:
                rest[(g, k)] = (r["a"], r["b"], rank)
        for (g, a, b) in {(g, a, b) for (g, _), (a, b, _) in small.items()}:
            rows = values.filter(F.col("g").eqNullSafe(F.lit(g)) & F.col("v").between(a, b)).orderBy("v").select("v", "n").collect()
            for (h, k), (x, y, rank) in small.items():
                if (h, x, y) == (g, a, b):
                    for v, n in rows:                        # SELECT_VALUES rows at most
                        if rank < n:
                            found[(h, k)] = v
                            break
                        rank -= n
        todo = rest
    return found


def likes_boxplot(df: DataFrame, value: str = "favorite_count", by: str = "sentiment") -> DataFrame:
    """Five-number summary with 1.5 IQR fences per group (linear-interpolation quartiles), exact by selection.

    Groups are labels: their ranks and intervals are a few numbers each on the driver, values never are.
    """
    spark, kind = df.sparkSession, df.schema[by].dataType.simpleString()
    values = materialize(df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
                         .agg(F.count(F.lit(1)).alias("n")), "boxplot-values")
    groups = values.groupBy("g").agg(F.sum("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max")).collect()
    wanted = {r["g"]: sorted({k for q in (1, 2, 3) for k in ((r["n"] - 1) * q // 4, -(-(r["n"] - 1) * q // 4))}) for r in groups}
    found, rows = order_statistics(values, wanted), []
    for r in groups:
        marks = []
        for q in (1, 2, 3):
            at = (r["n"] - 1) * q
            low, high = found[(r["g"], at // 4)], found[(r["g"], -(-at // 4))]
            marks.append(low + (high - low) * (at % 4) / 4)
        iqr = marks[2] - marks[0]
        rows.append((r["g"], r["n"], r["min"], *marks, r["max"], marks[0] - 1.5 * iqr, marks[2] + 1.5 * iqr))
    out = spark.createDataFrame(rows, f"{by} {kind}, n long, min double, q1 double, median double, q3 double, max double, "
                                      "lower_fence double, upper_fence double")
    return out.select(by, "n", "min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "max",
                      *[F.round(c, 6).alias(c) for c in ("lower_fence", "upper_fence")])


def distinct_labels(df: DataFrame, col: str = "sentiment") -> DataFrame:
    """Distinct labels, sorted."""
    return df.select(col).distinct().orderBy(col)


def pct1(num: Column, den: Column) -> Column:
    """Percentage rounded half-even to one decimal with a zero guard."""
    return F.when(den > 0, F.bround(num * 100.0 / den, 1)).otherwise(F.lit(0.0))
