"""One quoted CSV file read by many tasks gives the records of a plain reader."""

from __future__ import annotations

import csv
import random

import pytest

from textlab.functions.scoring import lexicon_scorer
from textlab.plans import labelling as L
from textlab.sources import posts as P
from textlab.sources.csv_records import records


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def posts(seed: int, n: int = 300) -> list[list[str]]:
    rng = random.Random(seed)
    parts = ["word", ",", '"', "\n", " ", "é", '""', "\n\n", "x" * 40, "1"]
    return [[f"t{k}" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12 if k % 50 else 120))), str(k), rng.choice(["", "anna", "b,b"])]
            for k in range(n)]


def write(path, rows, encoding="utf-8", end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding=encoding) as f:
        w = csv.writer(f, lineterminator=end, quoting=quoting)
        w.writerow(["full_text", "id_str", "username"])
        w.writerows(rows)


@pytest.mark.parametrize("seed,encoding,quoting", [(1, "utf-8", csv.QUOTE_MINIMAL), (2, "latin-1", csv.QUOTE_MINIMAL),
                                                   (3, "utf-8", csv.QUOTE_ALL), (4, "utf-8-sig", csv.QUOTE_MINIMAL)])
def test_rows_equal_those_written(spark, tmp_path, small_splits, seed, encoding, quoting):
    rows = posts(seed)
    write(tmp_path / "in.csv", rows, encoding, quoting=quoting)
    got = P.parse_posts(spark, str(tmp_path / "in.csv"))
    assert spark.read.text(str(tmp_path / "in.csv")).rdd.getNumPartitions() > 8
    found = {int(r.id_str): [r.full_text, r.id_str, r.username or ""] for r in got.filter("NOT _too_long").collect()}
    assert found == {k: r for k, r in enumerate(rows)} and got.count() == len(rows)


def test_line_ends_of_two_characters(spark, tmp_path, small_splits):
    rows = [[t.replace('"', "'"), k, u] for t, k, u in posts(5)]
    write(tmp_path / "in.csv", [[t.replace("\n", "\r\n"), k, u] for t, k, u in rows], end="\r\n")
    got = {r.id_str: r.full_text for r in P.read_posts_with_fallback(spark, str(tmp_path / "in.csv")).collect()}
    assert got == {k: t for t, k, _ in rows}


def test_split_reader_equals_whole_file_reader(spark, tmp_path):
    """Short, long, blank and half-quoted records, stray quotes, no quotes at all, and one record over most of the splits."""
    pad = "".join(f"plain {k},{k},u\n" for k in range(40))
    odd = ('short\n' + pad + '\n"a ""q""\nb",5,"x\n\ny"\nextra,6,u,\nstray"quote,7,u\n"end"tail,8,u\n"many,9\n' + "long line\n" * 60 + '",9,u\n,,\n'
           + pad + '"",10,\nlast,11,u')
    (tmp_path / "in.csv").write_text("full_text,id_str,username\n" + odd)

    def read():
        rows = P.parse_posts(spark, str(tmp_path / "in.csv")).collect()
        return sorted((r.full_text or "", r.id_str or "", r.username or "", r._too_long, r._corrupt_record.strip() if r._too_long else "") for r in rows)

    whole = read()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("61", "300", "2000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert read() == whole
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(whole) == 89


def test_open_quotes_header_only_and_labelling(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("full_text,id_str\n" + "x,1\n" * 200 + '"never closed,2\nmore\n')
    got = records(spark, str(tmp_path / "a.csv")).collect()
    assert [r.record for r in got if not r.closed] == ['"never closed,2\nmore'] and len(got) == 201
    (tmp_path / "b.csv").write_text("\n\nfull_text," + ",".join(f"column_{k}" for k in range(60)) + "\n\n\n")
    assert records(spark, str(tmp_path / "b.csv")).count() == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")          # the store's tables are read with it as well
    write(tmp_path / "c.csv", posts(6))
    assert spark.read.text(str(tmp_path / "c.csv")).rdd.getNumPartitions() > 1
    res = L.label_file(spark, str(tmp_path / "c.csv"), str(tmp_path / "out"), lexicon_scorer(["word"], ["x"]))
    p = res.progress.first()
    assert (p.rows, p.saved, p.skipped) == (300, 300, 0) and res.labeled.count() == 300
    assert {r.sentiment: r.n for r in res.stats.collect()} == {s: res.labeled.filter(f"sentiment = '{s}'").count() for s in
                                                               ("negative", "neutral", "positive")}


def test_only_records_over_a_splits_end_are_shuffled(spark, tmp_path, monkeypatch):
    from textlab.sources import csv_records
    made = {}

    def keep(df, name):
        made[name] = materialize(df, name)
        return made[name]

    materialize = csv_records.materialize
    monkeypatch.setattr(csv_records, "materialize", keep)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        write(tmp_path / "in.csv", [[f"a\nb\n{k}", str(k), "u"] for k in range(1000)])
        got = records(spark, str(tmp_path / "in.csv"))
        assert sorted(r.record for r in got.collect()) == sorted(f'"a\nb\n{k}",{k},u' for k in range(1000))
        splits = spark.read.text(str(tmp_path / "in.csv")).rdd.getNumPartitions()
        assert 2 < splits < 10 and made["csv-splits"].count() <= 3 * splits        # totals, an end and a beginning each
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
