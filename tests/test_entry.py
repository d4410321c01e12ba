"""Driver contract: entry() runs, every query key is callable, every oracle SQL agrees (DuckDB, sf0.001)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from textlab.sources.tables import TABLES

ROWS_ONLY = {"threshold_tree_nodes", "tree_nodes", "tree_rules_text", "tree_edges", "tree_model_report", "stem_text"}
# every query with oracle SQL is compared at sf0.001 (the driver compares them again at sf0.01)
SAMPLE = sorted(E.oracle_sql())


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) >= {"sentiment"}


def test_every_query_has_oracle_or_is_rows_only():
    from textlab.plans.catalog import QUERIES
    assert set(QUERIES) - set(E.oracle_sql()) == ROWS_ONLY
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())
