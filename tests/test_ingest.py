"""CSV reading, column checks, dates and likes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textlab import schema as S
from textlab.functions.dates import format_created_at, likes_to_int, parse_created_at
from textlab.sources import posts as P


def test_dates(spark):
    rows = [("Mon Dec 30 14:24:08 +0000 2024",), ("Mon Dec 30 14:24:08 +0700 2024",), ("2024-12-30 14:24:08",),
            ("garbage",), (None,)]
    df = spark.createDataFrame(rows, "raw string")
    got = [r[0] for r in df.select(parse_created_at("raw")).collect()]
    want = dt.datetime(2024, 12, 30, 14, 24, 8)
    assert got == [want, want, want, None, None]      # offset dropped, wall clock kept


def test_store_path_passes_non_day_strings(spark):
    df = spark.createDataFrame([("Mon Dec 30 14:24:08 +0000 2024",), ("2024-01-01",)], "raw string")
    assert [r[0] for r in df.select(format_created_at("raw")).collect()] == ["2024-12-30 14:24:08", "2024-01-01"]


@pytest.mark.parametrize("raw,val", [("12", 12), ("12.0", 12), ("", 0), (None, 0), ("abc", 0), ("206", 206)])
def test_likes_to_int(spark, raw, val):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(likes_to_int("x")).first()[0] == val


def write(tmp_path, name, data: bytes):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


def test_csv_short_row_kept_long_row_dropped(spark, tmp_path):
    data = ('full_text,favorite_count,username\n"hello, world",3,ann\nshort row\n'
            'too,many,fields,here\n"multi\nline",5,bob\n').encode()
    df = P.read_posts(spark, write(tmp_path, "a.csv", data))
    got = sorted((r.full_text, r.favorite_count) for r in df.collect())
    assert got == [("hello, world", "3"), ("multi\nline", "5"), ("short row", None)]


def test_csv_header_only(spark, tmp_path):
    df = P.read_posts(spark, write(tmp_path, "h.csv", b"full_text,favorite_count\n"))
    assert df.count() == 0 and "full_text" in df.columns


def test_csv_latin1_fallback(spark, tmp_path):
    data = "full_text\ncaf\xe9 ol\xe9\n".encode("latin-1")
    df = P.read_posts_with_fallback(spark, write(tmp_path, "l.csv", data))
    assert df.first().full_text == "café olé"


def test_required_and_missing_columns(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", None, None)], "full_text string, location string, username string")
    P.require_columns(df)
    with pytest.raises(Exception):
        P.require_columns(df.drop("full_text"))
    miss = {r.column_name: r for r in P.missing_columns(df, S.OPTIONAL_COLUMNS).collect()}
    assert set(miss) == set(S.OPTIONAL_COLUMNS)
    assert not miss["username"].missing and miss["username"].n_filled == 1
    assert miss["location"].missing and miss["location"].present          # present but all null
    assert miss["favorite_count"].missing and not miss["favorite_count"].present


def test_add_missing_columns_and_scorable(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "full_text string")
    full = P.add_missing_columns(df)
    assert set(S.OPTIONAL_COLUMNS) <= set(full.columns)
    assert P.scorable(full).count() == 1
    # Q3: absent likes become 0, not '' (every row survives the popularity rule)
    from textlab.operators.rules import popularity
    out = full.withColumn("sentiment", F.lit("positive")).select(popularity("favorite_count", "sentiment")).collect()
    assert [r[0] for r in out] == ["Normal"] * 3
