"""The registered queries of the operators: thin digests over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import (ann, html_text, language_id, line_dedup, lm, mixing, packing, periodic_runs, quality, secret_scan,
                         simhash, token_files, whitening)
from textlab.llm.common import read_table
from textlab.llm.oracle_queries import ORACLE_SQL  # noqa: F401 - read by the driver's entry
from textlab.sources.scratch import scratch_path


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner product for every vector whose id is divisible by 20."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: base counts and digest, and all spans."""
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, base rules and the adaptive verdict of every document."""
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to Simple-8b files; positions, counts and checksums as read back from them."""
    path = scratch_path(spark, "token-files")
    token_files.write(read_table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (hex) and near-duplicate component of every document: 4-word shingles, 4 bits."""
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place in it: 1,024 tokens to a sequence."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document that repeat an earlier document or place, with the document that keeps them."""
    return line_dedup.repeated_spans(read_table(spark, sf_dir, "documents"), compare_short=True, lines=True).select(
        "doc_id", "start", "end", "n_words", "first_doc_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the attention model and under the word unigram."""
    return lm.score(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten with a planted periodic tail: count, longest, digests of runs and of what is kept."""
    docs = read_table(spark, sf_dir, "documents")
    text = periodic_runs.with_planted_runs(F.col("doc_id"), F.col("text"))
    return periodic_runs.digests(periodic_runs.find_runs(docs.select("doc_id", text.alias("text"))))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three documents in four, with the spans of mixed texts."""
    return language_id.predict(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on up to 16 whitened components of the exact scatter."""
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    each = found.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n",
                       F.expr("try_cast(deviation AS long)").alias("deviation"), F.col("c.whitened").alias("whitened"),
                       F.col("c.explained").alias("explained"), "identity_error")


QUERIES = {
    "op1_hash_prefix_forest": op1_hash_prefix_forest,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_simhash": op6_simhash,
    "op7_html_text": op7_html_text,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_language_id": op12_language_id,
    "op13_whitening": op13_whitening,
}
