"""Text cleaning and tokenising as native Column expressions.

The character classes reproduce CPython's Unicode ``\\w`` and ``\\s`` in Java regex syntax, so the
expression runs inside whole-stage codegen instead of a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# CPython's \w over all code points is exactly letters, numbers and underscore.
WORD = r"\p{L}\p{N}_"
# CPython's \s: C0 separators, space, NEL and the Unicode separators.
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"

URL_RE = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
MENTION_RE = rf"@[{WORD}]+"
HASH = "#"
# non-words to spaces and runs of spaces to one, in one pass: no space is a word character; a-z0-9 are tested first
GAP_RE = rf"[^a-z0-9{WORD}]+"
TOKEN_RE = rf"[{WORD}]{{2,}}"
# largest word table that is broadcast to every task
BROADCAST_MAX_WORDS = 1_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """T1-T6 in order: lower, drop URLs, drop mentions, drop '#', non-word to space, squeeze + trim."""
    x = F.lower(_col(c))
    x = F.regexp_replace(x, URL_RE, "")
    x = F.regexp_replace(x, MENTION_RE, "")
    x = F.replace(x, F.lit(HASH))
    x = F.regexp_replace(x, GAP_RE, " ")
    return F.trim(x)


def split_words(c) -> Column:
    """White-space tokens of an already-cleaned text (empty text -> empty array)."""
    c = _col(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def vector_tokens(c) -> Column:
    """Vectoriser tokens, runs of two or more word characters."""
    return F.regexp_extract_all(_col(c), F.lit(TOKEN_RE), 0)


def remove_stopwords(c, stop_words) -> Column:
    """Drop stop words from a cleaned text, rejoin with one space.

    ``stop_words`` is a small literal list (a few hundred words at most) or an ``array<string>`` Column,
    e.g. a scalar subquery over a bounded stop-word table; the test runs inside the row's own task, so
    no words are shuffled. For an unbounded table use :func:`remove_stopwords_df`.
    """
    if isinstance(stop_words, Column):
        stop = stop_words
    else:
        stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.array_join(F.filter(split_words(c), lambda w: ~F.array_contains(stop, w)), " ")


def remove_stopwords_df(df: DataFrame, id_col: str, text_col: str, stop_df: DataFrame,
                        out_col: str = "text_nostop") -> DataFrame:
    """T9 with a stop-word table: explode words with their position, anti-join the table, rebuild.

    The stop-word table is broadcast only after its size is checked (at most ``BROADCAST_MAX_WORDS``);
    a larger table goes through a shuffle anti-join, where AQE splits skewed word partitions.
    """
    words = df.select(id_col, F.posexplode(split_words(text_col)).alias("pos", "word"))
    stop = stop_df.select(F.col(stop_df.columns[0]).alias("word"))
    if stop.limit(BROADCAST_MAX_WORDS + 1).count() <= BROADCAST_MAX_WORDS:
        stop = F.broadcast(stop)
    kept = words.join(stop, "word", "left_anti")
    rebuilt = kept.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]),
                     " ").alias(out_col))
    return df.join(rebuilt, id_col, "left").withColumn(out_col, F.coalesce(F.col(out_col), F.lit("")))


def english_stop_words() -> list[str]:
    """Spark ML's built-in English stop-word list (181 words), read from the Spark ML jar so that no
    running JVM is needed (SQL text built before a session exists); falls back to the ML API."""
    import glob
    import os
    import zipfile

    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for j in jars:
        with zipfile.ZipFile(j) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                return z.read(name).decode("utf-8").split()
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords("english")


def lemmatize(df: DataFrame, id_col: str, text_col: str, lemma_df: DataFrame, out_col: str = "lemmatized") -> DataFrame:
    """Replace each word by its lemma from a ``(token, lemma)`` table; unknown words stay.

    Words are exploded with their position, left-joined to the lemma table on the word (a shuffle or
    broadcast join chosen by AQE from the table's size) and re-assembled in order.
    """
    words = df.select(id_col, F.posexplode(split_words(text_col)).alias("pos", "token"))
    joined = words.join(lemma_df.select("token", "lemma"), "token", "left")
    rebuilt = joined.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "token").alias("w")))),
                                 lambda s: s["w"]), " ").alias(out_col))
    return df.join(rebuilt, id_col, "left").withColumn(out_col, F.coalesce(F.col(out_col), F.lit("")))
