"""Vocabulary, term counts and TF-IDF in long form.

Long form ``(id, term, tf)`` keeps the work distributed: a document's terms are counted inside its row, corpus
counts are combined map-side per term before the shuffle, and the vocabulary (at most ``max_features`` rows, a proven bound)
is broadcast to every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab import schema as S
from textlab.functions.text import vector_tokens


def doc_terms(df: DataFrame, id_col: str = "id", text_col: str = "preprocessed_text") -> DataFrame:
    """``(id, term, tf)`` for every distinct token of every document, one row of ``df`` each.

    Counted inside the row: the sorted tokens' runs of equal ones are the counts, so no token is shuffled. Tokens are sorted
    by their natural order, and a lambda, which Spark interprets, looks once at each. A row without tokens has no runs; it is
    not filtered out, as Spark would move that below the shuffle that spreads the texts, and clean and split every text there
    a second time, in as few tasks as the file has splits.
    """
    t = df.select(F.col(id_col).alias("id"), F.sort_array(vector_tokens(text_col)).alias("_s"))
    s, at = F.col("_s"), F.col("_at")
    first = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))
    t = t.select("id", "_s", F.when(F.size(s) > 0, first).alias("_at"))
    end = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s)))
    t = t.select("id", F.transform(at, lambda i: F.get(s, i)).alias("_term"), "_at", end.alias("_end"))
    t = t.select("id", F.inline(F.arrays_zip("_term", "_at", "_end")).alias("term", "_from", "_to"))
    return t.select("id", "term", (F.col("_to") - F.col("_from")).cast("long").alias("tf"))


def term_stats(terms: DataFrame) -> DataFrame:
    """Corpus frequency ``n`` and document frequency ``df`` per term (partial aggregation absorbs hot terms)."""
    return terms.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


def top_terms(terms: DataFrame, k: int = S.MAX_FEATURES) -> DataFrame:
    """L2: the ``k`` most frequent terms (ties by term) with rank; a bounded top-k, not a global sort.

    Output also carries ``idx``, the term's column in alphabetical order (L5 / V1).
    """
    st = term_stats(terms)
    top = st.orderBy(F.desc("n"), F.asc("term")).limit(k)
    from pyspark.sql import Window
    return top.select("term", "n", "df",
                      F.row_number().over(Window.orderBy(F.desc("n"), F.asc("term"))).cast("int").alias("rank"),
                      (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("idx"))


def term_counts(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """V1 / V3: counts restricted to the vocabulary; unknown terms are dropped (broadcast semi-join)."""
    return terms.join(F.broadcast(vocab.select("term", "idx")), "term", "inner").select("id", "term", "idx", "tf")


def tfidf(terms_in_vocab: DataFrame, docs: DataFrame, id_col: str = "id", norm: bool = True) -> DataFrame:
    """V2: ``tf * (ln((1+n)/(1+df)) + 1)``, rows L2-normalised; ``n`` counts all documents.

    ``df`` per vocabulary term is an aggregate of at most ``max_features`` rows (broadcast back);
    the row norm is a window per document.
    """
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    dfs = terms_in_vocab.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    w = terms_in_vocab.join(F.broadcast(dfs), "term").withColumn("w", F.col("tf") * idf)
    if norm:
        from pyspark.sql import Window
        nrm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
        w = w.withColumn("w", F.col("w") / nrm)
    return w.select("id", "term", "idx", "tf", F.col("w").alias("tfidf"))
