"""The native cleaning and tokenising expressions equal CPython's ``re`` semantics."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlab.functions.text import clean_text, remove_stopwords, split_words, vector_tokens


def py_clean(t: str) -> str:
    """The cleaning steps written with Python's own regex engine (independent of the Spark code)."""
    t = t.lower()
    t = re.sub(r"https?://\S+|www\.\S+", "", t)
    t = re.sub(r"@\w+", "", t)
    t = re.sub(r"#", "", t)
    t = re.sub(r"[^\w\s]", " ", t)
    return re.sub(r"\s+", " ", t).strip()


CASES = [
    "Visit https://example.com/x?y=1 now!!", "see www.example.org/page ok", "@user_1 hello @Other",
    "#Tag and #tag2 kept", "emoji 😀 gone", "x² keeps the superscript", "AT&amp;T fish &amp; chips",
    "no break space", "Ça va, Straße, ÉLAN", "   ", "!!!", "tab\tand\nnewline\x85nel",
    "under_score stays", "mixed123 numbers 4567",
]


def test_clean_inline_cases(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, t string")
    got = dict(df.select("id", clean_text("t").alias("c")).collect())
    for i, t in enumerate(CASES):
        assert got[i] == py_clean(t), (t, got[i], py_clean(t))


def test_clean_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(clean_text("t")).first()[0] is None


def test_clean_all_documents_equal_cpython(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    out = docs.select("doc_id", "text", clean_text("text").alias("c")).toPandas()
    bad = [r.doc_id for r in out.itertuples() if r.c != py_clean(r.text)]
    assert bad == []


def test_tokens_equal_python_findall(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", clean_text("text").alias("c"))
    out = docs.select("doc_id", "c", vector_tokens("c").alias("tok")).toPandas()
    for r in out.itertuples():
        assert list(r.tok) == re.findall(r"\w{2,}", r.c)


def test_split_words_empty_text(spark):
    df = spark.createDataFrame([("",), ("a b",)], "t string")
    assert [r[0] for r in df.select(F.size(split_words("t"))).collect()] == [0, 2]


@pytest.mark.parametrize("text,expected", [("the cat and the hat", "cat hat"), ("the and", ""), ("", "")])
def test_remove_stopwords(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(remove_stopwords("t", ["the", "and"])).first()[0] == expected


# scripts and symbols whose Unicode properties are the same in Java 17 (Unicode 13) and CPython 3.13
# (Unicode 15.1): Latin, Greek, Cyrillic, Arabic, Devanagari, general punctuation and spaces, CJK, emoji
_RANGES = [(0x0000, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF), (0x0600, 0x06FF), (0x0900, 0x097F),
           (0x2000, 0x206F), (0x3000, 0x303F), (0x4E00, 0x4FFF), (0x1F300, 0x1F64F)]


def test_clean_property_random_unicode(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    char = st.one_of(*[st.integers(a, b).map(chr) for a, b in _RANGES])
    batches = st.lists(st.lists(char, max_size=40).map("".join), min_size=30, max_size=30)

    @settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
    @given(batches)
    def check(batch):
        df = spark.createDataFrame(list(enumerate(batch)), "id int, t string")
        got = {r.id: (r.c, list(r.tok)) for r in
               df.select("id", clean_text("t").alias("c"), vector_tokens(clean_text("t")).alias("tok")).collect()}
        for i, t in enumerate(batch):
            c = py_clean(t)
            assert got[i] == (c, re.findall(r"\w{2,}", c)), repr(t)

    check()
