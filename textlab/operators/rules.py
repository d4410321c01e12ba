"""Rule application (R1, R2a, R2b), rule mining (R3), rule text (R4), JSON round trip (R5, T17), edges.

Rule sets are tiny (tens of rows), so applying them compiles to one ``CASE WHEN`` chain on the driver;
the chain runs inside whole-stage codegen. Mining is two grouped aggregations over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab import schema as S


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confidence_tier(confidence, rules: list[tuple[str, float, str]], sentiment=None,
                    match_sentiment: bool = False) -> Column:
    """Label of the first rule, in stored order, with ``confidence >= threshold``; none -> null.

    ``rules`` are ``(rule_name, threshold, label)``. The rule's own sentiment is ignored unless
    ``match_sentiment`` (then ``rule_name`` must start with ``<sentiment>_``).
    """
    conf = _col(confidence)
    out = None
    for name, thr, label in rules:
        cond = conf >= F.lit(float(thr))
        if match_sentiment and sentiment is not None:
            cond = cond & (_col(sentiment) == F.lit(name.split("_")[0]))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out if out is not None else F.lit(None).cast("string")


def sentiment_category(sentiment, confidence, rules: dict[str, list[tuple[str, float, str]]]) -> Column:
    """Within the row's own sentiment, the first level with ``confidence >= confidence_threshold``."""
    sent, conf = _col(sentiment), _col(confidence)
    out = None
    for s, levels in rules.items():
        for _level, thr, label in levels:
            cond = (sent == F.lit(s)) & (conf >= F.lit(float(thr)))
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out if out is not None else F.lit(None).cast("string")


def popularity(likes, sentiment, rules: dict | None = None) -> Column:
    """Viral (label by sentiment) / popular / normal; every missing part of ``rules`` uses the default."""
    rules = rules or {}
    viral = rules.get("viral") or {}
    popular = rules.get("popular") or {}
    normal = rules.get("normal") or {}
    v_thr = viral.get("threshold", S.VIRAL_THRESHOLD)
    cats = {**S.VIRAL_LABELS, **(viral.get("categories") or {})}
    p_thr = popular.get("min_threshold", S.POPULAR_THRESHOLD)
    p_lab = popular.get("label", S.POPULAR_LABEL)
    n_lab = normal.get("label", S.NORMAL_LABEL)
    lk, sent = F.coalesce(_col(likes), F.lit(0)), _col(sentiment)
    viral_label = F.element_at(F.create_map(*[F.lit(x) for kv in cats.items() for x in kv]), sent)
    return (F.when(lk >= F.lit(v_thr), viral_label)
            .when(lk >= F.lit(p_thr), F.lit(p_lab))
            .otherwise(F.lit(n_lab)))


def apply_rules(df: DataFrame, conf_rules, cat_rules=None, pop_rules=None, confidence="confidence",
                sentiment="sentiment", likes="favorite_count") -> DataFrame:
    """R1 + R2a + R2b as three columns of the same row (they are kept, not dropped)."""
    return (df.withColumn("confidence_level", confidence_tier(confidence, conf_rules))
              .withColumn("sentiment_category", sentiment_category(sentiment, confidence, cat_rules or {}))
              .withColumn("popularity", popularity(likes, sentiment, pop_rules)))


def conf_range(confidence) -> Column:
    """Truncation to one decimal, ``int(x*10)/10``."""
    return F.floor(_col(confidence) * 10) / 10


def likes_band(likes) -> Column:
    """A14 band of a likes value: high (>= 1000), medium (>= 100), else low."""
    lk = F.coalesce(_col(likes), F.lit(0))
    return F.when(lk >= S.LIKES_HIGH, "high").when(lk >= S.LIKES_MEDIUM, "medium").otherwise("low")


def confidence_patterns(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Counts per (sentiment, 0.1-bucket) with the first input id where the pattern occurs."""
    return (df.groupBy("sentiment", conf_range("confidence").alias("conf_range"))
              .agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_seen")))


def likes_patterns(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Counts per (sentiment, likes band)."""
    return (df.groupBy("sentiment", likes_band("favorite_count").alias("like_range"))
              .agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_seen")))


def level_of(bucket) -> Column:
    """R3 level of a 0.1 confidence bucket: very_high / high / medium / low."""
    b = _col(bucket)
    out = None
    for cut, name in S.LEVEL_CUTS:
        out = F.when(b >= cut, name) if out is None else out.when(b >= cut, name)
    return out.otherwise(S.LEVEL_ELSE)


def mine_confidence_rules(df: DataFrame, id_col: str = "id", min_count: int = S.MIN_PATTERN_COUNT) -> DataFrame:
    """Confidence rules from frequent (sentiment, bucket) patterns.

    A pattern with more than ``min_count`` rows gives rule ``<sentiment>_<level>``; when several
    patterns map to one rule the one seen last (by first input id) wins, and rules are ordered by the
    first time their key was produced. Both orders come from input ids, never arrival order.
    The window runs over the pattern table (at most sentiments x 11 rows).
    """
    pats = confidence_patterns(df, id_col).filter(F.col("n") > min_count)
    pats = pats.withColumn("level", level_of("conf_range"))
    rules = (pats.groupBy("sentiment", "level")
                 .agg(F.max_by(F.struct("conf_range", "n"), "first_seen").alias("w"),
                      F.min("first_seen").alias("key_first_seen")))
    label = F.concat(F.initcap(F.translate("level", "_", " ")), F.lit(" "), F.initcap("sentiment"))
    ordw = Window.orderBy("key_first_seen")
    return rules.select(
        F.lit("confidence_rules").alias("rule_type"),
        F.concat_ws("_", "sentiment", "level").alias("rule_name"),
        F.row_number().over(ordw).cast("int").alias("ordinal"),
        F.col("w.conf_range").alias("threshold"),
        F.col("w.n").alias("count"),
        label.alias("label"))


def shipped_rules(spark: SparkSession) -> DataFrame:
    """The shipped confidence rules as a rule table (``ordinal`` = stored order, 1-based)."""
    rows = [("confidence_rules", n, i + 1, float(t), int(c), lab)
            for i, (n, t, c, lab) in enumerate(S.SHIPPED_CONFIDENCE_RULES)]
    return spark.createDataFrame(rows, "rule_type string, rule_name string, ordinal int, threshold double, "
                                       "count bigint, label string")


def rule_list(rules_df: DataFrame, rule_type: str = "confidence_rules") -> list[tuple[str, float, str]]:
    """Bring a rule table (bounded: a few dozen rows) to the driver in stored order to compile a chain."""
    rows = (rules_df.filter(F.col("rule_type") == rule_type)
                    .orderBy("ordinal").select("rule_name", "threshold", "label").collect())
    return [(r[0], r[1], r[2]) for r in rows]


def rules_text(spark: SparkSession, rules_df: DataFrame) -> DataFrame:
    """``(line_no, line)`` of the human-readable rule file, header lines for all four groups."""
    types = spark.createDataFrame([(i + 1, t) for i, t in enumerate(S.RULE_TYPES)], "type_ord int, rule_type string")
    headers = types.select("type_ord", F.lit(0).alias("ordinal"),
                           F.concat(F.lit("\n" + S.RULE_TEXT_CATEGORY + ": "), F.upper("rule_type")).alias("line"))
    cond = F.when(F.col("threshold").isNotNull(),
                  F.concat(F.lit("confidence >= "), F.col("threshold").cast("string"))).otherwise(F.lit(""))
    body = (rules_df.join(F.broadcast(types), "rule_type")
                    .select("type_ord", "ordinal",
                            F.concat(F.lit(S.RULE_TEXT_IF + " "), cond, F.lit(" " + S.RULE_TEXT_THEN + " "),
                                     F.col("label")).alias("line")))
    allr = headers.unionByName(body)
    w = Window.orderBy("type_ord", "ordinal")
    return allr.select(F.row_number().over(w).cast("int").alias("line_no"), "line")


def rules_to_json(rules_df: DataFrame) -> DataFrame:
    """T17 encode: ``rule_data`` JSON text per rule (the stored form). Text that came with a rule is kept whole, so nested
    groups (levels per sentiment, viral categories) lose nothing."""
    data = F.to_json(F.struct("threshold", "count", "label"))
    if "rule_data" in rules_df.columns:
        data = F.coalesce(F.col("rule_data"), data)
    return rules_df.select("rule_type", "rule_name", "ordinal", data.alias("rule_data"))


def rules_from_json(stored: DataFrame) -> DataFrame:
    """T17 decode + R5: keep the four known rule groups, with ``rule_data`` whole and the flat fields parsed from it."""
    parsed = F.from_json("rule_data", S.RULE_DATA)
    return (stored.filter(F.col("rule_type").isin(*S.RULE_TYPES))
                  .select("rule_type", "rule_name", "ordinal", "rule_data",
                          parsed["threshold"].alias("threshold"), parsed["count"].alias("count"),
                          parsed["label"].alias("label")))


def load_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """Rules file ``{rule_type: {rule_name: {...}}}`` -> rule table; key order becomes ``ordinal``.

    What stands under a rule name is kept as JSON text, at any depth.
    """
    raw = spark.read.text(path, wholetext=True)
    groups = raw.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("rule_type", "rules"))
    return rules_from_json(groups.select("rule_type", F.posexplode("rules").alias("pos", "rule_name", "rule_data")).select(
        "rule_type", "rule_name", (F.col("pos") + 1).cast("int").alias("ordinal"), "rule_data"))


def _nested(rules_df: DataFrame, rule_type: str) -> dict:
    """The rules of one group as nested dicts in stored order (bounded: a few dozen rows)."""
    import json
    if "rule_data" not in rules_df.columns:
        return {}
    rows = rules_df.filter(F.col("rule_type") == rule_type).orderBy("ordinal").select("rule_name", "rule_data").collect()
    return {r[0]: json.loads(r[1]) for r in rows if r[1] is not None}


def category_rules(rules_df: DataFrame) -> dict[str, list[tuple[str, float, str]]]:
    """R2a rules of a rule table: sentiment -> levels ``(name, confidence threshold, label)`` in stored order."""
    return {s: [(level, float(r["confidence_threshold"]), r["label"]) for level, r in levels.items()]
            for s, levels in _nested(rules_df, "sentiment_classification").items()}


def popularity_rules(rules_df: DataFrame) -> dict:
    """R2b rules of a rule table, as :func:`popularity` takes them."""
    return _nested(rules_df, "popularity_rules")


def rules_edges(rules_df: DataFrame) -> DataFrame:
    """Graph edges ``input -> rule`` per category, labelled with the threshold condition."""
    return rules_df.select(
        F.col("rule_type").alias("category"), F.lit("input").alias("src"), F.col("rule_name").alias("dst"),
        F.concat(F.lit(">= "), F.col("threshold").cast("string")).alias("edge_label"),
        F.col("label").alias("node_label"))
