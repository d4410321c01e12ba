"""Helpers shared by the operators: text columns as bytes, fresh column names, distributed positions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.sources.scratch import materialize

#: The white space that separates words, as in ``[^\x20\x09-\x0D]+``. ``bytes.split()`` uses the same set.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole, through Spark's reader (the path may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value of a string column; null is the empty text."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Every value of a string column; null is the empty text."""
    return [s if s is not None else "" for s in column.to_pylist()]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have (compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def same(a: Column, b: Column) -> Column:
    """Equality that also pairs null with null."""
    return a.eqNullSafe(b)


def power_of_two(n: float) -> int:
    """Smallest power of two that is at least ``n`` (1 for anything below)."""
    return 1 << max(0, math.ceil(math.log2(n))) if n > 1 else 1


def star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One large-star or small-star step over undirected ``edges`` (u, v).

    The per-node minimum is written before it is joined back: both join inputs are then plain
    exchanges, and Spark splits the partition of a node with very many neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("low"))
                      .select(F.col("u").alias("node"), F.least("u", "low").alias("low")), f"{name}-low")
    joined = both.join(low, both["u"] == low["node"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            low.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v, comparable, no nulls); root is the component's smallest node.

    Alternating large-star and small-star steps; every step is written to the shared folder, so a
    lost executor costs one step. Raises if ``max_rounds`` steps do not settle it.
    """
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .filter("u <> v").distinct(), f"{name}-edges")
    digest = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == digest:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        digest = (row["n"], row["h"])
        now = materialize(star(now, True, name), f"{name}-large")
        now = materialize(star(now, False, name), f"{name}-small")
    raise RuntimeError(f"{name}: not settled after {max_rounds} rounds")
