"""Porter stemming, checked on words from the algorithm's published description."""

from __future__ import annotations

import random

import pytest

from textlab.functions.stem import porter_stem, stem_text, stem_words
from textlab.functions.stem import STEP2, STEP3, STEP4

CASES = [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"),
         ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"),
         ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
         ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"),
         ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
         ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"), ("digitizer", "digit"),
         ("operator", "oper"), ("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"),
         ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"),
         ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"),
         ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"),
         ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"), ("is", "is")]


@pytest.mark.parametrize("word,stem", CASES)
def test_porter_examples(word, stem):
    assert porter_stem(word) == stem


def test_stem_text_keeps_order(spark):
    df = spark.createDataFrame([(1, "the cats were running"), (2, ""), (3, "ponies ponies")], "id long, t string")
    got = {r.id: r.stemmed for r in stem_text(df, "id", "t").collect()}
    assert got == {1: "the cat were run", 2: "", 3: "poni poni"}


def test_columns_equal_plain_version(spark):
    """Words of every shape of c, vowel, y and rule suffix, and words out of the alphabet."""
    rng = random.Random(7)
    ends = ["", "s", "es", "ies", "sses", "eed", "ed", "ing", "y", "e", "ll", *STEP4, *(a for a, _ in STEP2 + STEP3)]
    words = {"".join(rng.choice("aeioyybtlswxz") for _ in range(rng.randint(0, 6))) + rng.choice(ends) + rng.choice(ends) for _ in range(6000)}
    words |= {w for w, _ in CASES} | {"y", "yy", "yyying", "syying", "ayyed", "ééed", "über11ing", "𝒳𝒳ing", "1111ed", "_" * 3, "a" * 20_000 + "ing",
                                      "by" * 20_000 + "ing", "x" * 20_000 + "yed"}
    df = spark.createDataFrame([(w,) for w in sorted(words)] + [(None,)], "word string")
    got = {r.word: r.stem for r in stem_words(df).collect()}
    assert got.pop(None) is None
    assert {w: s for w, s in got.items() if s != porter_stem(w)} == {}


def test_stem_text_awkward_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "cats"), (None, "cats"), (2, "")], "id long, t string")
    assert sorted((r.id or 0, r.stemmed) for r in stem_text(df, "id", "t").collect()) == [(0, "cat"), (1, ""), (1, "cat"), (2, "")]
    assert stem_text(df.limit(0), "id", "t").count() == 0


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "cats")], "id long, t string")
    plan = stem_text(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
