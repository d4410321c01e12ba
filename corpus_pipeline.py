"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing, one operator of textlab.llm a stage.

Each stage takes all rows that its predecessor kept, is written as Parquet, and is read again as the next one's docs.
All stages read whole texts, however long, count null text as empty, allow null and repeated ids, keep extra columns
whatever their names (the last one returns pieces instead), and make an empty table of an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.llm import mixing, packing, quality, secret_scan, simhash
from textlab.session import ensure_checkpoint_dir, ship_package
from textlab.sources.scratch import scratch_path


def ready(spark: SparkSession) -> None:
    """A stage may be called by itself: its workers need the package, its scratch tables the shared folder."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's adaptive thresholds keep; the others go.

    Null and empty texts go; null languages and sources are groups of their own; equal rows are judged alike.
    """
    ready(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: 4-word shingles, links at 4 or fewer differing bits, the smallest doc_id stays.

    Null ids come last; of rows equal in id and text one stays; texts without words have fingerprint 0 and link like any other.
    """
    ready(spark)
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text replaced by a mark. Null texts stay null, equal rows stay as many."""
    ready(spark)
    return secret_scan.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, a source's last one cut to the words that are still wanted.

    Documents without words are not taken; the null source is a source of its own; equal rows share what is taken of them.
    """
    ready(spark)
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their sequence and place in it. Rows of a document taken twice are packed as two."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer and no SimHash; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
