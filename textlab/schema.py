"""Schemas, label domains and the fixed rule values the engine must reproduce."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the original application's for equal results).
# ---------------------------------------------------------------------------------------------
# class index -> sentiment, in index order
SENTIMENTS = ["negative", "neutral", "positive"]
# split types
SPLIT_TYPES = ["train", "test"]
# rule groups, in this order
RULE_TYPES = ["confidence_rules", "sentiment_classification", "popularity_rules", "impact_rules"]
# shipped confidence rules, in stored order: (name, threshold, count, label)
SHIPPED_CONFIDENCE_RULES = [
    ("positive_very_high", 0.8, 32, "Very High Positive"),
    ("neutral_very_high", 0.9, 87, "Very High Neutral"),
    ("positive_medium", 0.5, 15, "Medium Positive"),
    ("negative_very_high", 0.9, 36, "Very High Negative"),
    ("positive_high", 0.6, 19, "High Positive"),
    ("neutral_high", 0.6, 13, "High Neutral"),
    ("neutral_medium", 0.5, 12, "Medium Neutral"),
]
# default popularity rules
VIRAL_THRESHOLD = 1000
POPULAR_THRESHOLD = 100
VIRAL_LABELS = {"positive": "Viral Positive", "neutral": "Viral Neutral", "negative": "Viral Negative"}
POPULAR_LABEL = "Popular"
NORMAL_LABEL = "Normal"
# likes bands of the pattern miner: high >= 1000, medium >= 100, else low
LIKES_HIGH = 1000
LIKES_MEDIUM = 100
# rule mining: patterns need more than this many rows; level cut points
MIN_PATTERN_COUNT = 10
LEVEL_CUTS = [(0.8, "very_high"), (0.6, "high"), (0.4, "medium")]
LEVEL_ELSE = "low"
# shipped path rules: (node_id, [(feature, op, threshold)], label)
SHIPPED_PATH_RULES = [
    (1, [("kata_positif", "<=", 1.0)], "negative"),
    (2, [("kata_positif", ">", 1.0)], "positive"),
]
# shipped linear feature weights, in stored order
SHIPPED_FEATURE_WEIGHTS = [
    ("kata_positif", 1.5),
    ("kata_negatif", -1.5),
    ("jumlah_tanda_seru", 0.3),
    ("jumlah_kata", 0.1),
    ("skor_likes", 0.8),
    ("skor_dislikes", -0.8),
]
# rule-text keywords and tree-text keywords
RULE_TEXT_CATEGORY = "KATEGORI"
RULE_TEXT_IF = "JIKA"
RULE_TEXT_THEN = "MAKA"
TREE_TEXT_ELSE_IF = "JIKA TIDAK, JIKA"
TREE_TEXT_CLASS = "MAKA Sentimen ="
TREE_INDENT = "    "
# model-name format
MODEL_NAME_PREFIX = "sentiment_model_"
MODEL_NAME_TS_FORMAT = "yyyyMMdd_HHmmss"
# required / optional ingest columns
REQUIRED_COLUMN = "full_text"
OPTIONAL_COLUMNS = ["favorite_count", "created_at", "location", "username"]
CLIENT_REQUIRED_COLUMNS = ["conversation_id_str", "created_at", "favorite_count", "full_text", "id_str"]
# import defaults for null fields
IMPORT_DEFAULT_SOURCE = "imported"
IMPORT_DEFAULT_SENTIMENT = "neutral"
DEFAULT_SOURCE = "user_input"
PROCESSED_SOURCE = "processed_data"
# split defaults
SPLIT_SEED = 42
DEFAULT_TRAIN_PERCENT = 80
MAX_FEATURES = 2000
HISTOGRAM_BINS = 20
# columns of a post CSV, and of the joined view
TWEET_COLUMNS = [
    "conversation_id_str", "created_at", "favorite_count", "full_text", "id_str", "image_url",
    "in_reply_to_screen_name", "lang", "location", "quote_count", "reply_count", "retweet_count",
    "tweet_url", "user_id_str", "username",
]
LABELED_VIEW_COLUMNS = ["id", "text", "preprocessed_text", "sentiment", "confidence", "favorite_count",
                        "created_at", "location", "username", "source_dataset"]
# ---------------------------------------------------------------------------------------------

# Tweet CSV as exported by the scraper; everything is read as text and cast explicitly.
TWEET_CSV = T.StructType([T.StructField(c, T.StringType(), True) for c in TWEET_COLUMNS])

TEXTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("preprocessed_text", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("source_dataset", T.StringType(), True),
])
SENTIMENTS_TABLE = T.StructType([
    T.StructField("text_id", T.LongType(), False),
    T.StructField("sentiment", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
])
METADATA = T.StructType([
    T.StructField("text_id", T.LongType(), False),
    T.StructField("favorite_count", T.IntegerType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("username", T.StringType(), True),
])
DATASET_SPLITS = T.StructType([
    T.StructField("text_id", T.LongType(), False),
    T.StructField("split_type", T.StringType(), False),
])
RULES = T.StructType([
    T.StructField("rule_type", T.StringType(), False),
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("rule_data", T.StringType(), False),
])
RULE_DATA = T.StructType([
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("count", T.LongType(), True),
    T.StructField("label", T.StringType(), True),
])
MODEL_REGISTRY = T.StructType([
    T.StructField("model_name", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("accuracy", T.DoubleType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])
