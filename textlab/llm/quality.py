"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

A sketch is a histogram over log-linear buckets (exact below 32, then 16 buckets per doubling, so a
quantile is at most 1/16 low). Sketches merge by adding counts: per (language, source) first, those into
languages, those into one for all. Documents are then judged by joining the thresholds of the
finest group that has enough rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textlab.llm.common import ASCII_SPACE, as_bytes, fresh, same
from textlab.sources.scratch import materialize

# fixed values of the base rules
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A group's own sketch counts from so many documents; below, its language's, then that of all documents.
MIN_GROUP = 200
#: metric -> (side, per cent). A text fails beyond its group's quantile at that level by more than FENCE_SPREAD
#: interquartile ranges of the group. Where more than three quarters of all texts have 0 the level is above them: nine in
#: ten have no symbols, while a few repeated lines or words are found in good texts too. The metrics are whole numbers: per
#: mille of words or lines, and hundredths of characters per word.
FENCES = {"symbols_pm": ("high", 90), "dup_lines_pm": ("high", 99), "repeat_pm": ("high", 99), "word_len_c": ("both", 75)}
FENCE_SPREAD = 4
#: Least distance of a limit from its quantile: the width of the sketch's exact range.
LEAST = 32

STATS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_lines:long>"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_KEEP = bytes(range(0x80, 0xC0))        # UTF-8 continuation bytes: every other byte begins a code point
_MIX = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more among ``words``, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) == len(words):
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += (ids[k:k + n] + np.uint64(1)) * _MIX[k]
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():                 # equal windows have equal sums
        return 0
    _, at = np.unique(np.lib.stride_tricks.sliding_window_view(ids, window)[
        np.isin(mixed, order[1:][order[1:] == order[:-1]])], axis=0, return_inverse=True)
    starts = np.flatnonzero(np.isin(mixed, order[1:][order[1:] == order[:-1]]))
    starts = starts[np.bincount(at.ravel())[at.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def stats(data: bytes) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of one whole text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (len(words), len(data.translate(None, ASCII_SPACE + _KEEP)), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def _stats_column(column: pa.Array) -> pa.Array:
    rows = [stats(b) for b in as_bytes(column)]
    cols: Iterable = zip(*rows) if rows else [()] * len(_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(_FIELDS))


def text_stats(text: Column) -> Column:
    """Struct of :func:`stats` of a text column."""
    return arrow_udf(_stats_column, STATS)(text)


def metrics(s: Column) -> dict[str, Column]:
    """The whole-number metrics that are sketched, from a struct of text statistics; null without words."""
    words = F.when(s["n_words"] > 0, s["n_words"])
    return {"symbols_pm": F.floor(s["n_symbols"] * 1000 / words), "dup_lines_pm": F.floor(s["n_dup_lines"] * 1000 / s["n_lines"]),
            "repeat_pm": F.floor(s["n_repeat_words"] * 1000 / words), "word_len_c": F.floor(s["word_chars"] * 100 / words)}


def bucket(v: Column) -> Column:
    """Lower bound of the log-linear bucket of a whole number >= 0."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return (F.floor(v / step) * step).cast("long")


def sketch(rows: DataFrame, lang: str, source: str, stat: str) -> DataFrame:
    """(lang, source, metric, low, n): the histogram sketches of ``rows``, by partial aggregation."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("value"))
                                for k, v in metrics(F.col(stat)).items()]))
    return (rows.filter(F.col(f"{stat}.n_words") > 0)
            .select(F.col(lang).alias("lang"), F.col(source).alias("source"), cells.alias("c"))
            .groupBy("lang", "source", F.col("c.metric").alias("metric"), bucket(F.col("c.value")).alias("low"))
            .agg(F.count("*").alias("n")))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, q1, q3, low, high) from sketches, merged over the columns that are not ``keys``.

    ``high`` is the quantile at the metric's level, ``low`` the one as far from the other end.
    """
    merged = sketches.groupBy(*keys, "metric", F.col("low").alias("cell")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")                # at most 32 + 16 x 59 buckets
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    level = F.lit(50)
    for m, (_, percent) in FENCES.items():
        level = F.when(F.col("metric") == m, F.lit(percent)).otherwise(level)

    def at(percent: Column) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("all") * percent, F.col("cell")))

    return run.groupBy(*keys, "metric").agg(F.max("all").alias("n"), at(F.lit(25)).alias("q1"), at(F.lit(75)).alias("q3"),
                                            at(100 - level).alias("low"), at(level).alias("high"))


def thresholds(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): ``high_<metric>`` and ``low_<metric>`` limits, values beyond which a text fails."""
    marks = ("q1", "q3", "low", "high")
    own = quantiles(sketches, ["lang", "source"])
    by_lang = quantiles(sketches, ["lang"]).select(F.col("lang").alias("l2"), F.col("metric").alias("m2"), F.col("n").alias("n2"),
                                                   *[F.col(q).alias(f"{q}_2") for q in marks])
    of_all = quantiles(sketches, []).select(F.col("metric").alias("m3"), *[F.col(q).alias(f"{q}_3") for q in marks])
    j = (own.join(by_lang, same(own["lang"], F.col("l2")) & (own["metric"] == F.col("m2")))
         .join(of_all, own["metric"] == F.col("m3")))
    for q in marks:
        j = j.withColumn(f"use_{q}", F.when(F.col("n") >= min_group, F.col(q))
                         .when(F.col("n2") >= min_group, F.col(f"{q}_2")).otherwise(F.col(f"{q}_3")))
    far = F.greatest(F.lit(FENCE_SPREAD) * (F.col("use_q3") - F.col("use_q1")), F.lit(LEAST))
    out = []
    for m, (side, _) in FENCES.items():
        here = F.col("metric") == m
        out.append(F.max(F.when(here, F.col("use_high") + far)).alias(f"high_{m}"))
        if side == "both":
            out.append(F.max(F.when(here, F.col("use_low") - far)).alias(f"low_{m}"))
    return j.groupBy("lang", "source").agg(*out)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)


def verdict(rows: DataFrame, limits: DataFrame, lang: str, source: str, stat: str, out: str) -> DataFrame:
    """``rows`` with boolean ``out``: base rules passed and no metric beyond its group's limits.

    ``limits`` has a row per group: small as a rule, then Spark broadcasts it by its file size; else both sides
    are shuffled and hot groups are split by adaptive execution.
    """
    s, ok = F.col(stat), F.lit(True)
    for m, v in metrics(s).items():
        side, _ = FENCES[m]
        ok = ok & F.coalesce(v <= F.col(f"high_{m}"), F.lit(True))
        if side == "both":
            ok = ok & F.coalesce(v >= F.col(f"low_{m}"), F.lit(True))
    lim = limits.withColumnsRenamed({"lang": "_limit_lang", "source": "_limit_source"})
    joined = rows.join(lim, same(rows[lang], F.col("_limit_lang")) & same(rows[source], F.col("_limit_source")), "left")
    return joined.withColumn(out, ~base_failed(s) & ok)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
          min_group: int = MIN_GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    Null text has no words and fails; null languages and sources form groups of their own; ids may repeat or be null
    (they are only carried); an empty table gives an empty result; other columns are not read.
    """
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"),
                                   F.col(source).alias("source"), text_stats(F.col(text)).alias("s")), "quality-stats")
    limits = materialize(thresholds(sketch(rows, "lang", "source", "s"), min_group), "quality-limits")
    out = verdict(rows, limits, "lang", "source", "s", "kept")
    return out.select("doc_id", *[F.col(f"s.{k}").alias(k) for k in _FIELDS[:5]],
                      base_failed(F.col("s")).alias("base_failed"), "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
              min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns.

    Rows are written once with their text statistics: the sketches and the verdict read those, so no text is
    scanned twice. Nothing is joined by id: repeated or null ids are safe. Null or empty text has no words and goes;
    null languages and sources are groups of their own; very long texts are judged whole; an empty table stays empty.
    """
    stat, kept = fresh(docs, "_stats", "_kept")
    rows = materialize(docs.withColumn(stat, text_stats(F.col(text))), "quality-rows")
    limits = materialize(thresholds(sketch(rows, lang, source, stat), min_group), "quality-limits")
    return verdict(rows, limits, lang, source, stat, kept).filter(F.col(kept)).select(*docs.columns)
