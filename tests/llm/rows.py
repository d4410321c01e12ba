"""Small fixtures for the operators: the sf0.001 documents, and a table of awkward rows."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
LONG = "word " * 40_000 + "end."
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of sf0.001 as rows."""
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names the operators use."""
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, LONG, "en", "a", len(LONG)), (2, LONG, "en", "a", len(LONG)),
            (3, "Same text here, with some words in it.", None, "b", 38), (4, "Same text here, with some words in it.", "en", None, 38),
            (None, "Same text here, with some words in it.", "en", "b", 38), (5, "\n\n \t", "de", "", 4), (6, "\x00  é́  ", "de", "c", 6),
            (6, "other words under a repeated id", "de", "c", 31)]
    extra = "component_id string, size string, kept int, fingerprint string, start int, ids string, _print int, _stats int, row int, task int"
    return spark.createDataFrame([r + (None, "x", 7, "f", 1, "i", 2, 3, 4, 5) for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
