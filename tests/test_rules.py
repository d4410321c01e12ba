"""R1-R7 and quirks Q1, Q2, Q4: rule semantics on inline rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from textlab import schema as S
from textlab.operators import rules as R


def conf_rules():
    return [(n, t, lab) for n, t, _c, lab in S.SHIPPED_CONFIDENCE_RULES]


def test_shipped_tiers_first_match_in_stored_order(spark):
    # Q2: only two tiers are reachable with the shipped order
    rows = [(0.95, "negative"), (0.80, "neutral"), (0.65, "positive"), (0.50, "negative"), (0.49, "positive")]
    df = spark.createDataFrame(rows, "confidence double, sentiment string")
    got = [r[0] for r in df.select(R.confidence_tier("confidence", conf_rules())).collect()]
    assert got == ["Very High Positive", "Very High Positive", "Medium Positive", "Medium Positive", None]


def test_tier_matching_sentiment_option(spark):
    df = spark.createDataFrame([(0.95, "negative")], "confidence double, sentiment string")
    got = df.select(R.confidence_tier("confidence", conf_rules(), "sentiment", match_sentiment=True)).first()[0]
    assert got == "Very High Negative"


def test_popularity_defaults_when_rules_empty(spark):
    # Q1: empty popularity rules fall back to the defaults instead of dropping the row
    rows = [(1000, "negative"), (999, "positive"), (100, "neutral"), (99, "positive"), (None, "positive")]
    df = spark.createDataFrame(rows, "likes int, sentiment string")
    got = [r[0] for r in df.select(R.popularity("likes", "sentiment", {})).collect()]
    assert got == ["Viral Negative", "Popular", "Popular", "Normal", "Normal"]


def test_popularity_partial_rules(spark):
    df = spark.createDataFrame([(50, "positive"), (10, "positive")], "likes int, sentiment string")
    got = [r[0] for r in df.select(R.popularity("likes", "sentiment", {"popular": {"min_threshold": 20}})).collect()]
    assert got == ["Popular", "Normal"]


def test_sentiment_category_uses_own_sentiment(spark):
    rules = {"positive": [("strong", 0.8, "SP"), ("mild", 0.5, "MP")], "negative": [("strong", 0.8, "SN")]}
    rows = [("positive", 0.9), ("positive", 0.6), ("negative", 0.6), ("neutral", 0.99)]
    df = spark.createDataFrame(rows, "sentiment string, confidence double")
    got = [r[0] for r in df.select(R.sentiment_category("sentiment", "confidence", rules)).collect()]
    assert got == ["SP", "MP", None, None]


def brute_force_mine(rows, min_count=10):
    """The rule miner written as a plain loop over rows in id order (dict insertion order semantics)."""
    import math
    pats = {}
    for _id, sent, conf in sorted(rows):
        key = (sent, math.floor(conf * 10) / 10)
        pats[key] = pats.get(key, 0) + 1
    out = {}
    for (sent, bucket), n in pats.items():
        if n <= min_count:
            continue
        level = "very_high" if bucket >= 0.8 else "high" if bucket >= 0.6 else "medium" if bucket >= 0.4 else "low"
        out[f"{sent}_{level}"] = (bucket, n, f"{level.replace('_', ' ').title()} {sent.title()}")
    return out


def test_mined_rules_equal_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.choice(S.SENTIMENTS), round(rnd.uniform(0.3, 0.99), 4)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, sentiment string, confidence double")
    got = R.mine_confidence_rules(df).orderBy("ordinal").collect()
    exp = brute_force_mine(rows)
    assert [r.rule_name for r in got] == list(exp)          # same rules, same order
    for r in got:
        b, n, lab = exp[r.rule_name]
        assert (round(r.threshold, 6), r["count"], r.label) == (round(b, 6), n, lab)


def test_rules_json_roundtrip_keeps_order(spark, tmp_path):
    p = tmp_path / "rules.json"
    data = {"confidence_rules": {n: {"threshold": t, "count": c, "label": lab}
                                 for n, t, c, lab in S.SHIPPED_CONFIDENCE_RULES},
            "sentiment_classification": {}, "popularity_rules": {}, "impact_rules": {}}
    p.write_text(json.dumps(data))
    df = R.load_rules_json(spark, str(p))
    assert R.rule_list(df) == conf_rules()
    back = R.rules_from_json(R.rules_to_json(df))
    assert R.rule_list(back) == conf_rules()


def test_rules_text_has_four_headers(spark):
    lines = [r.line for r in R.rules_text(spark, R.shipped_rules(spark)).orderBy("line_no").collect()]
    assert sum(1 for x in lines if x.startswith("\nKATEGORI: ")) == 4
    assert "JIKA confidence >= 0.8 MAKA Very High Positive" in lines


def test_unknown_rule_type_dropped(spark):
    stored = spark.createDataFrame([("confidence_rules", "a", 1, '{"threshold":0.5,"count":1,"label":"A"}'),
                                    ("other", "b", 1, '{"threshold":0.5,"count":1,"label":"B"}')],
                                   "rule_type string, rule_name string, ordinal int, rule_data string")
    assert [r.rule_name for r in R.rules_from_json(stored).collect()] == ["a"]


def test_nested_rule_files_lose_nothing(spark, tmp_path):
    from textlab.sources import store as ST
    data = {"confidence_rules": {"any": {"threshold": 0.5, "count": 3, "label": "Sure"}},
            "sentiment_classification": {"positive": {"strong": {"confidence_threshold": 0.9, "label": "Very Good"},
                                                      "mild": {"confidence_threshold": 0.5, "label": "Good"}}},
            "popularity_rules": {"viral": {"threshold": 10, "categories": {"positive": "Up", "negative": "Down"}},
                                 "popular": {"min_threshold": 5, "label": "Known"}}}
    (tmp_path / "rules.json").write_text(json.dumps(data))
    ST.save_rules(R.load_rules_json(spark, str(tmp_path / "rules.json")), str(tmp_path / "store"))
    rules = ST.load_rules(spark, str(tmp_path / "store"))
    assert R.rule_list(rules) == [("any", 0.5, "Sure")]
    assert R.category_rules(rules) == {"positive": [("strong", 0.9, "Very Good"), ("mild", 0.5, "Good")]}
    assert R.popularity_rules(rules) == data["popularity_rules"]
    df = spark.createDataFrame([("positive", 0.95, 12), ("positive", 0.6, 7), ("negative", 0.95, 11), ("neutral", 0.2, 0)],
                               "sentiment string, confidence double, favorite_count int")
    got = R.apply_rules(df, R.rule_list(rules), R.category_rules(rules), R.popularity_rules(rules)).collect()
    assert [(r.confidence_level, r.sentiment_category, r.popularity) for r in got] == [
        ("Sure", "Very Good", "Up"), ("Sure", "Good", "Known"), ("Sure", None, "Down"), (None, None, S.NORMAL_LABEL)]
