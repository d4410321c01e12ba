"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of the inventory.

Each reads the driver's tables (or what Spark derives from them) in full; the matching DuckDB SQL
lives in :mod:`textlab.plans.oracle_queries`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab import schema as S
from textlab.functions.dates import OUT_FORMAT, likes_to_int, parse_created_at as parse_created_at_col
from textlab.functions.scoring import feature_score as feature_score_col, path_rules as path_rules_col, \
    path_rules_node
from textlab.functions.text import clean_text as clean_col, remove_stopwords as remove_stopwords_col, \
    split_words, vector_tokens, lemmatize
from textlab.operators import evaluate as EV, features as FE, rules as R, split as SP, stats as ST
from textlab.sources import posts as P, store as STORE
from textlab.sources.scratch import scratch_path
from textlab.sources.tables import base_tables, labeled, scored_documents, table, truth

# ---------------------------------------------------------------------------------------------
# Test parameters of the catalogue (ours, not the original application's): a small lexicon for the
# linear feature score, category rules for R2a, a lemma table, the stop-word cut and the tree size.
# ---------------------------------------------------------------------------------------------
POSITIVE_WORDS = ["the", "and", "und", "la", "et"]
NEGATIVE_WORDS = ["of", "die", "de", "que", "les"]
CATEGORY_RULES = {
    "positive": [("strong", 0.8, "Strongly Positive"), ("mild", 0.5, "Mildly Positive")],
    "neutral": [("clear", 0.7, "Clearly Neutral"), ("weak", 0.4, "Weakly Neutral")],
    "negative": [("strong", 0.8, "Strongly Negative"), ("mild", 0.5, "Mildly Negative")],
}
LEMMAS = [("was", "be"), ("is", "be"), ("are", "be"), ("were", "be"), ("has", "have"), ("had", "have"),
          ("les", "le"), ("la", "le"), ("die", "der"), ("das", "der")]
STOPWORD_TOP = 50
TREE_TERMS = S.MAX_FEATURES
TREE_LEVELS = 3
PREVIEW_ROWS = 10
LIMIT_ROWS = 100
TRAIN_PERCENT = 80
# ---------------------------------------------------------------------------------------------


def shipped_conf_rules() -> list[tuple[str, float, str]]:
    """The shipped confidence rules as ``(name, threshold, label)`` in stored order."""
    return [(n, t, lab) for n, t, _c, lab in S.SHIPPED_CONFIDENCE_RULES]


# ----------------------------------------------------------------------------------- clean
def q_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned text of every document and every web page (pages exercise URL removal)."""
    d = table(spark, sf, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"),
                                             clean_col("text").alias("preprocessed_text"))
    p = table(spark, sf, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"),
                                         clean_col("html").alias("preprocessed_text"))
    return d.unionByName(p)


def _clean_docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), clean_col("text").alias("t"))


def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Word and token counts and the vectoriser tokens of every cleaned document."""
    c = _clean_docs(spark, sf).withColumn("tok", vector_tokens("t"))
    return c.select("id", F.size(split_words("t")).alias("n_words"), F.size("tok").alias("n_tokens"),
                    F.size(F.array_distinct("tok")).alias("n_distinct"), F.array_join("tok", " ").alias("tokens"))


def q_remove_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the 50 most frequent words (a stop-word table derived from the data)."""
    c = _clean_docs(spark, sf)
    words = c.select(F.explode(split_words("t")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(STOPWORD_TOP)
    stop = top.agg(F.collect_list("word")).scalar()
    # the bounded (50-word) list is evaluated once as a scalar subquery and bound to a column first:
    # subqueries may not sit inside the lambda itself
    x = c.withColumn("_stop", stop)
    return x.select("id", remove_stopwords_col("t", F.col("_stop")).alias("text_nostop"))


# ----------------------------------------------------------------------------------- score
def q_softmax_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Class probabilities, sentiment and confidence of every document."""
    s = scored_documents(spark, sf)
    return s.select("id", "sentiment", "confidence",
                    *[F.round(F.col("probs")[i], 6).alias(f"p_{lab}") for i, lab in enumerate(S.SENTIMENTS)])


def q_label_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Scorable labelled rows with confidence tier, category and popularity."""
    lab = P.scorable(labeled(spark, sf), "text")
    out = R.apply_rules(lab, shipped_conf_rules(), {}, None)
    return out.select("id", "preprocessed_text", "sentiment", "confidence",
                      F.coalesce("favorite_count", F.lit(0)).alias("favorite_count"),
                      "confidence_level", "sentiment_category", "popularity")


def _features(spark, sf) -> DataFrame:
    lab = labeled(spark, sf)
    words = split_words("preprocessed_text")
    pos = F.array(*[F.lit(w) for w in POSITIVE_WORDS])
    neg = F.array(*[F.lit(w) for w in NEGATIVE_WORDS])
    return lab.select(
        "id",
        F.size(F.filter(words, lambda w: F.array_contains(pos, w))).alias("kata_positif"),
        F.size(F.filter(words, lambda w: F.array_contains(neg, w))).alias("kata_negatif"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).alias("jumlah_tanda_seru"),
        F.size(words).alias("jumlah_kata"),
        F.coalesce("favorite_count", F.lit(0)).alias("skor_likes"),
        F.lit(0).alias("skor_dislikes"))


def q_feature_score(spark: SparkSession, sf: str) -> DataFrame:
    """Linear feature score with the shipped weights."""
    f = _features(spark, sf)
    return f.select("id", "kata_positif", "kata_negatif", "jumlah_tanda_seru", "jumlah_kata",
                    F.round(feature_score_col(S.SHIPPED_FEATURE_WEIGHTS), 6).alias("score"))


def q_path_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Label and node of the first shipped path rule whose predicates all hold."""
    f = _features(spark, sf)
    return f.select("id", "kata_positif", path_rules_col(S.SHIPPED_PATH_RULES).alias("path_label"),
                    path_rules_node(S.SHIPPED_PATH_RULES).alias("node_id"))


def q_python_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """A Python lexicon scorer over Arrow batches, then P1 as SQL functions."""
    from textlab.functions.scoring import classify_logits, lexicon_scorer, score_with
    lab = labeled(spark, sf)
    scored = classify_logits(score_with(lab, lexicon_scorer(POSITIVE_WORDS, NEGATIVE_WORDS)))
    return scored.select("id", "sentiment", "confidence", "_error")


def q_label_csv(spark: SparkSession, sf: str) -> DataFrame:
    """P4 end to end: labelled rows written as a post CSV, then read, checked, cleaned, scored by the
    Python lexicon scorer, given the shipped rules and stored as three tables."""
    from textlab.functions.scoring import lexicon_scorer
    from textlab.plans.labelling import label_file
    res = label_file(spark, _posts_csv(spark, sf), scratch_path(spark, "label-csv-store"),
                     lexicon_scorer(POSITIVE_WORDS, NEGATIVE_WORDS))
    return res.labeled.select("id", "sentiment", "confidence", "favorite_count", "confidence_level", "popularity")


def q_csv_split_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with line breaks and quotes inside, written as CSV and read line by line in splits."""
    from textlab.sources import posts as P
    path = scratch_path(spark, "split-csv")
    text = F.replace("text", F.lit(". "), F.lit('."\n'))
    P.write_csv(table(spark, sf, "documents").select(text.alias("full_text"), F.col("doc_id").cast("string").alias("id_str")), path)
    rows = P.parse_split(spark, path, ["full_text", "id_str"], "UTF-8", False)
    return rows.select(F.col("id_str").cast("long").alias("id"), "full_text", F.col(P.LONG).alias("too_long"))


def q_stem_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every cleaned document with its words replaced by their Porter stems."""
    from textlab.functions.stem import stem_text
    return stem_text(_clean_docs(spark, sf), "id", "t", "stemmed").select("id", "stemmed")


# ----------------------------------------------------------------------------------- ingest
def _posts_csv(spark, sf) -> str:
    """Write the labelled rows as a tweet CSV (K1) under the shared scratch folder; return its path."""
    lab = labeled(spark, sf)
    out = lab.select(
        F.col("id").cast("string").alias("id_str"), F.col("text").alias("full_text"),
        F.col("favorite_count").cast("string").alias("favorite_count"),
        F.date_format("created_at", "EEE MMM dd HH:mm:ss +0000 yyyy").alias("created_at"),
        "location", "username")
    path = scratch_path(spark, "posts-csv")
    P.write_csv(out, path)
    return path


def q_scan_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows written as a post CSV and read back as typed records."""
    path = _posts_csv(spark, sf)
    df = P.read_posts(spark, path)
    P.require_columns(df)
    rec = P.posts_record(df)
    return rec.select("id", "full_text", "favorite_count",
                      F.date_format("created_at", OUT_FORMAT).alias("created_at"), "location", "username")


def q_scorable_posts(spark: SparkSession, sf: str) -> DataFrame:
    """rows with non-empty text."""
    # the filter looks at the raw text: it reaches the scan, and no text is cleaned
    return P.scorable(scored_documents(spark, sf), "text").select("id", "sentiment", "confidence")


def q_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """per optional column, filled rows and whether it is missing."""
    return P.missing_columns(labeled(spark, sf), S.OPTIONAL_COLUMNS)


def q_preview_rows(spark: SparkSession, sf: str) -> DataFrame:
    """first rows by id with nulls shown as '' and the total row count."""
    lab = labeled(spark, sf).select(
        "id", F.col("text").alias("full_text"), "favorite_count",
        F.date_format("created_at", OUT_FORMAT).alias("created_at"), "location", "username")
    return P.preview(lab, "id", PREVIEW_ROWS)


def _raw_dates(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    raw = (F.when(F.col("event_type") == "view", F.date_format("ts", OUT_FORMAT))
            .when(F.col("event_type") == "error", F.lit("not a date"))
            .when(F.col("event_type") == "click", F.lit(None).cast("string"))
            .otherwise(F.date_format("ts", "EEE MMM dd HH:mm:ss +0700 yyyy")))
    return e.select("event_id", raw.alias("raw"))


def q_parse_created_at(spark: SparkSession, sf: str) -> DataFrame:
    """Social-media and ISO date texts parsed (offset dropped), junk and nulls to null."""
    r = _raw_dates(spark, sf)
    return r.select("event_id", "raw", F.date_format(parse_created_at_col("raw"), OUT_FORMAT).alias("created_at"))


def q_import_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Import defaults over the labelled rows (likes given as text, some as '12.0')."""
    lab = labeled(spark, sf)
    likes_text = F.when(F.col("location") == "view", F.concat(F.col("favorite_count").cast("string"), F.lit(".0"))) \
        .otherwise(F.col("favorite_count").cast("string"))
    x = P.import_defaults(lab.select("id", "text", "preprocessed_text", "source_dataset", "sentiment", "confidence",
                                     likes_text.alias("favorite_count"), "created_at", "location", "username"))
    return x.select("id", "text", "preprocessed_text", "source_dataset", "sentiment", "confidence", "favorite_count",
                    "location", "username")


def q_union_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Two inputs (English / other documents) tagged with their source and unioned."""
    s = scored_documents(spark, sf)
    a = s.filter(F.col("lang") == "en").withColumn("source_dataset", F.lit("data_latih_1"))
    b = s.filter(~(F.col("lang") == "en") | F.col("lang").isNull()).withColumn("source_dataset", F.lit("data_latih_2"))
    u = a.unionByName(b)
    return u.select("id", "source_dataset", clean_col("text").alias("preprocessed_text"), "sentiment", "confidence")


# ----------------------------------------------------------------------------------- rules
def q_confidence_tier(spark, sf):
    """First shipped confidence rule met, in stored order."""
    lab = labeled(spark, sf)
    return lab.select("id", "confidence", R.confidence_tier("confidence", shipped_conf_rules()).alias("confidence_level"))


def q_sentiment_category(spark, sf):
    """First category level of the row's own sentiment met."""
    lab = labeled(spark, sf)
    return lab.select("id", "sentiment", "confidence",
                      R.sentiment_category("sentiment", "confidence", CATEGORY_RULES).alias("sentiment_category"))


def q_popularity(spark, sf):
    """Viral / popular / normal by likes with the default thresholds."""
    lab = labeled(spark, sf)
    return lab.select("id", "sentiment", F.coalesce("favorite_count", F.lit(0)).alias("favorite_count"),
                      R.popularity("favorite_count", "sentiment").alias("popularity"))


def q_confidence_patterns(spark, sf):
    """Counts per (sentiment, 0.1 confidence bucket)."""
    return R.confidence_patterns(labeled(spark, sf))


def q_likes_patterns(spark, sf):
    """Counts per (sentiment, likes band)."""
    return R.likes_patterns(labeled(spark, sf))


def q_mine_confidence_rules(spark, sf):
    """Confidence rules mined from frequent patterns, first-seen order."""
    return R.mine_confidence_rules(labeled(spark, sf))


def q_rules_text(spark, sf):
    """The human-readable rule lines of the mined rules."""
    return R.rules_text(spark, R.mine_confidence_rules(labeled(spark, sf)))


def q_rules_roundtrip(spark, sf):
    """Mined rules stored as JSON and parsed back."""
    stored = R.rules_to_json(R.mine_confidence_rules(labeled(spark, sf)))
    path = scratch_path(spark, "rules")
    stored.write.mode("overwrite").partitionBy("rule_type").parquet(path)
    return R.rules_from_json(spark.read.parquet(path))


def q_rules_nested(spark, sf):
    """Nested category and popularity rules through a rules file, the rule store and back, then applied."""
    import json
    groups = {"sentiment_classification": {s: {lv: {"confidence_threshold": t, "label": lab} for lv, t, lab in levels}
                                           for s, levels in CATEGORY_RULES.items()},
              "popularity_rules": {"viral": {"threshold": 500, "categories": dict(S.VIRAL_LABELS)},
                                   "popular": {"min_threshold": 50, "label": S.POPULAR_LABEL},
                                   "normal": {"label": S.NORMAL_LABEL}}}
    file, store = scratch_path(spark, "rules-file"), scratch_path(spark, "rules-store")
    spark.createDataFrame([(json.dumps(groups),)], "value string").coalesce(1).write.text(file)
    STORE.save_rules(R.load_rules_json(spark, file), store)
    rules = STORE.load_rules(spark, store)
    out = R.apply_rules(labeled(spark, sf), R.rule_list(rules), R.category_rules(rules), R.popularity_rules(rules))
    return out.select("id", "sentiment_category", "popularity")


def q_import_append(spark, sf):
    """K4: the labelled rows imported twice by append: ids dense and distinct, the view not fanned out."""
    from textlab.plans.labelling import import_csv
    path, base = scratch_path(spark, "import-csv"), scratch_path(spark, "import-store")
    P.write_csv(scored_documents(spark, sf).select("id", "text", "sentiment", "confidence"), path)
    for _ in range(2):
        import_csv(spark, path, base, mode="append")
    return STORE.load_view(spark, base).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("min_id"),
        F.max("id").alias("max_id"))


def q_mixed_encodings(spark, sf):
    """One folder with UTF-8 and ISO-8859-1 files, the columns in another order in each; every text comes back."""
    folder = scratch_path(spark, "mixed")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("full_text"))
    narrow = F.col("full_text").rlike(r"^[\x00-\xFF]*$") & (F.pmod(F.col("id").cast("long"), F.lit(2)) == 0)
    docs.filter(narrow).select("full_text", "id").write.options(**P.CSV_WRITE_OPTIONS).option(
        "encoding", "ISO-8859-1").csv(folder)
    docs.filter(~narrow).select("id", "full_text").write.mode("append").options(**P.CSV_WRITE_OPTIONS).csv(folder)
    return P.read_posts_with_fallback(spark, folder).select(F.col("id").cast("long").alias("id"),
                                                            F.md5("full_text").alias("text_md5"))


def q_rules_edges(spark, sf):
    """Rule graph edges input -> rule, labelled with the threshold."""
    return R.rules_edges(R.mine_confidence_rules(labeled(spark, sf)))


# ----------------------------------------------------------------------------------- stats
def q_sentiment_counts(spark, sf):
    """A1: rows per sentiment in the sentiments table."""
    return ST.sentiment_counts(base_tables(spark, sf)["sentiments"])


def q_dataset_counts(spark, sf):
    """A2/L4: rows per source dataset."""
    return ST.dataset_counts(base_tables(spark, sf)["texts"])


def q_sentiment_stats(spark, sf):
    """A3: total rows, mean confidence, mean likes over the base tables."""
    b = base_tables(spark, sf)
    return ST.sentiment_stats(b["texts"], b["sentiments"], b["metadata"])


def q_stats_grouping_sets(spark, sf):
    """A4: counts and mean confidence by sentiment, by source and in total in one scan."""
    return ST.stats_grouping_sets(scored_documents(spark, sf))


def q_dashboard_stats(spark, sf):
    """A5: dashboard figures over the view."""
    return ST.dashboard_stats(labeled(spark, sf))


def q_sentiment_distribution(spark, sf):
    """Zero-filled counts per sentiment with percentages."""
    return ST.sentiment_distribution(spark, scored_documents(spark, sf))


def q_confidence_histogram(spark, sf):
    """20-bin confidence histogram."""
    return ST.confidence_histogram(scored_documents(spark, sf))


def q_likes_boxplot(spark, sf):
    """Likes quartiles and fences per sentiment."""
    return ST.likes_boxplot(labeled(spark, sf))


def q_distinct_labels(spark, sf):
    """The labels that occur."""
    return ST.distinct_labels(labeled(spark, sf))


# ----------------------------------------------------------------------------------- store
def _view(spark, sf):
    """The view as one join of texts with their scores and one left join with the metadata: three scans."""
    return labeled(spark, sf).select(*S.LABELED_VIEW_COLUMNS)


def q_labeled_view(spark, sf):
    """Texts JOIN scores LEFT JOIN metadata."""
    return _view(spark, sf)


def q_labeled_limit(spark, sf):
    """L1: the first rows of the view by id."""
    return _view(spark, sf).orderBy("id").limit(LIMIT_ROWS)


def q_filter_by_sentiment(spark, sf):
    """view rows of one sentiment."""
    return _view(spark, sf).filter(F.col("sentiment") == "positive")


def _stored(spark, sf) -> dict[str, str]:
    from textlab.sources.store import save_labeled
    lab = labeled(spark, sf).select(*S.LABELED_VIEW_COLUMNS, "has_metadata")
    return save_labeled(spark, lab, scratch_path(spark, "store"), natural_key="id")


def q_normalize_texts(spark, sf):
    """K3: the stored texts table (ids allocated once)."""
    return spark.read.parquet(_stored(spark, sf)["texts"])


def q_normalize_sentiments(spark, sf):
    """K3: the stored sentiments table."""
    return spark.read.parquet(_stored(spark, sf)["sentiments"])


def q_normalize_metadata(spark, sf):
    """K3: the stored metadata table (rows with metadata only)."""
    return spark.read.parquet(_stored(spark, sf)["metadata"])


# ----------------------------------------------------------------------------------- split
def _split(spark, sf) -> DataFrame:
    return SP.train_test_split(scored_documents(spark, sf).select("id"), "id", TRAIN_PERCENT)


def q_train_test_split(spark, sf):
    """Seeded exact 80/20 split."""
    return _split(spark, sf)


def q_split_preview(spark, sf):
    """Preview sizes with half-even rounding."""
    return SP.split_preview(scored_documents(spark, sf), TRAIN_PERCENT)


def _stored_splits(spark, sf) -> DataFrame:
    from textlab.sources.store import save_dataset_splits
    path = scratch_path(spark, "splits")
    save_dataset_splits(_split(spark, sf).withColumnRenamed("id", "text_id"), path)
    return spark.read.parquet(path)


def q_dataset_splits(spark, sf):
    """K5: the stored split table."""
    return _stored_splits(spark, sf).select("text_id", "split_type")


def _split_join(spark, sf, which):
    v = _view(spark, sf)
    s = _split(spark, sf).filter(F.col("split_type") == which)
    return v.join(s, v["id"] == s["id"], "inner").select(v["*"], s["split_type"])


def q_split_join_train(spark, sf):
    """View rows of the training split."""
    return _split_join(spark, sf, "train")


def q_split_join_test(spark, sf):
    """View rows of the test split."""
    return _split_join(spark, sf, "test")


def q_split_summary(spark, sf):
    """Total, train and test counts."""
    return SP.split_summary(base_tables(spark, sf)["texts"], _split(spark, sf))


def q_data_distribution(spark, sf):
    """A10: reconciled split summary with percentages."""
    return SP.data_distribution(SP.split_summary(base_tables(spark, sf)["texts"], _split(spark, sf)))


def q_test_distribution(spark, sf):
    """Zero-filled sentiment counts of the test split."""
    lab = labeled(spark, sf)
    s = _split(spark, sf).filter(F.col("split_type") == "test")
    return SP.test_distribution(spark, lab.join(s, "id", "left_semi"))


def q_batch_progress(spark, sf):
    """Labelling batch ledger."""
    return SP.batch_progress(labeled(spark, sf), "id", "text")


# ----------------------------------------------------------------------------------- features
def _doc_terms(spark, sf):
    """Documents and their ``(id, term, tf)``; the term table feeds the vocabulary and the counts, so it is
    written once to the shared scratch folder rather than tokenised twice."""
    from textlab.sources.scratch import materialize
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), clean_col("text").alias("t"))
    return d, materialize(FE.doc_terms(d, "id", "t"), "doc-terms")


def q_top_terms(spark, sf):
    """The 2000 most frequent terms with rank and alphabetical column."""
    _d, terms = _doc_terms(spark, sf)
    return FE.top_terms(terms, S.MAX_FEATURES)


def q_term_counts(spark, sf):
    """V1: per-document counts of vocabulary terms."""
    _d, terms = _doc_terms(spark, sf)
    return FE.term_counts(terms, FE.top_terms(terms, S.MAX_FEATURES))


def q_tfidf(spark, sf):
    """V2: TF-IDF with the +1 idf and L2 row norm."""
    d, terms = _doc_terms(spark, sf)
    tv = FE.term_counts(terms, FE.top_terms(terms, S.MAX_FEATURES))
    out = FE.tfidf(tv, d)
    return out.select("id", "term", "idx", "tf", F.round("tfidf", 6).alias("tfidf"))


def q_lemma_lookup(spark, sf):
    """Words replaced by their lemma from a lemma table."""
    d = _clean_docs(spark, sf)
    lem = spark.createDataFrame(LEMMAS, "token string, lemma string")
    return lemmatize(d, "id", "t", lem, "lemmatized").select("id", "lemmatized")


# ----------------------------------------------------------------------------------- evaluate
def _pred_truth(spark, sf):
    lab = labeled(spark, sf).select("id", F.col("sentiment").alias("predicted"))
    return lab.join(truth(spark, sf), "id", "inner")


def q_confusion_matrix(spark, sf):
    """Zero-filled confusion matrix of labels against the reference truth."""
    return EV.confusion_matrix(spark, _pred_truth(spark, sf))


def q_classification_report(spark, sf):
    """Per-class precision / recall / F1, averages and accuracy."""
    return EV.classification_report(EV.confusion_matrix(spark, _pred_truth(spark, sf)))


def q_accuracy(spark, sf):
    """Accuracy of the labels against the truth."""
    return EV.accuracy(_pred_truth(spark, sf))


# ----------------------------------------------------------------------------------- tree
def tree_inputs(spark, sf):
    """The gain-ratio tree's training matrix, configured like the application's training run: rows
    ``(id, label)`` of the training split (``TRAIN_PERCENT``, seed 42) and their non-zeros over the
    count vectoriser's vocabulary, i.e. the ``max_features`` most frequent training terms after English
    stop-word removal (V1, T9)."""
    from textlab.functions.text import english_stop_words
    from textlab.sources.scratch import materialize
    split = SP.train_test_split(labeled(spark, sf), "id", TRAIN_PERCENT)         # a comparison in the row: no text is moved
    tr = split.filter(F.col("split_type") == "train")
    rows = materialize(tr.select("id", F.col("sentiment").alias("label")), "tree-rows")
    stop = spark.createDataFrame([(w,) for w in english_stop_words()], "term string")    # 181 words
    # cleaning and tokenising is the heavy part; it feeds both the vocabulary and the matrix, so it is
    # written once to the shared scratch folder instead of being computed twice
    terms = materialize(FE.doc_terms(tr, "id", "preprocessed_text").join(F.broadcast(stop), "term", "left_anti"),
                        "tree-terms")
    vocab = FE.top_terms(terms, TREE_TERMS)
    nz = terms.join(F.broadcast(vocab.select("term")), "term").select("id", "term", "tf")
    return rows, nz


def q_gain_ratio_root(spark, sf):
    """Information gain, split information and gain ratio of every term at the root."""
    from textlab.operators import tree as TR
    rows, nz = tree_inputs(spark, sf)
    assign = rows.withColumn("node", F.lit(""))
    cnt = TR.label_counts(assign)
    g = TR.gain_ratios(assign, nz, cnt, TR.node_summary(cnt))
    return g.select("term", F.round("info_gain", 9).alias("info_gain"), F.round("split_info", 9).alias("split_info"),
                    F.round("gain_ratio", 9).alias("gain_ratio"), "n_values")


def q_gain_ratio_best(spark, sf):
    """L3: the root's best term (ties: alphabetically first)."""
    from textlab.operators import tree as TR
    rows, nz = tree_inputs(spark, sf)
    assign = rows.withColumn("node", F.lit(""))
    cnt = TR.label_counts(assign)
    b = TR.best_split(TR.gain_ratios(assign, nz, cnt, TR.node_summary(cnt)))
    return b.select("term", F.round("gain_ratio", 9).alias("gain_ratio"))


def _tree(spark, sf):
    from textlab.operators import tree as TR
    rows, nz = tree_inputs(spark, sf)
    from textlab.sources.scratch import materialize
    return TR.build_tree(rows, materialize(nz, "tree-nz"))


def q_tree_nodes(spark, sf):
    """M2: node table of the grown gain-ratio tree."""
    return _tree(spark, sf)


def q_tree_levels(spark, sf):
    """M2 with a depth limit, every level split by distributed jobs (no node is finished inside a task)."""
    from textlab.operators import tree as TR
    from textlab.sources.scratch import materialize
    rows, nz = tree_inputs(spark, sf)
    return TR.build_tree(rows, materialize(nz, "tree-nz"), max_depth=TREE_LEVELS, local_cells=0)


def q_tree_rules_text(spark, sf):
    """M5: the tree as indented rule lines."""
    from textlab.operators import tree as TR
    return TR.tree_rules_text(_tree(spark, sf))


def q_tree_edges(spark, sf):
    """M6: the tree's parent -> child edges."""
    from textlab.operators import tree as TR
    return TR.tree_edges(_tree(spark, sf))


def _threshold_tree(spark, sf, **limits):
    """The binary tree of the training matrix and the matrix itself: (nodes, rows, nz)."""
    from textlab.operators import threshold_tree as TT
    from textlab.sources.scratch import materialize
    rows, nz = tree_inputs(spark, sf)
    nz = materialize(nz.withColumnRenamed("tf", "value"), "threshold-nz")
    return TT.grow(rows, nz, **limits), rows, nz


def q_threshold_tree_levels(spark, sf):
    """M1 with a depth limit, every level split by distributed jobs (no node is finished inside a task)."""
    return _threshold_tree(spark, sf, max_depth=TREE_LEVELS, local_cells=0)[0]


def q_threshold_tree_predict(spark, sf):
    """Every training row's class and leaf by the depth-limited tree."""
    from textlab.operators import threshold_tree as TT
    return TT.predict(*_threshold_tree(spark, sf, max_depth=TREE_LEVELS))


def q_threshold_tree_rules(spark, sf):
    """M5: the depth-limited binary tree as numbered rule lines."""
    from textlab.operators import threshold_tree as TT
    return TT.rule_lines(_threshold_tree(spark, sf, max_depth=TREE_LEVELS)[0])


def q_threshold_tree_dot(spark, sf):
    """M6: the depth-limited binary tree as numbered DOT lines."""
    from textlab.operators import threshold_tree as TT
    return TT.dot_lines(_threshold_tree(spark, sf, max_depth=TREE_LEVELS)[0])


def q_threshold_tree_nodes(spark, sf):
    """M1 without a depth limit: the whole tree's node table; large nodes split by jobs, small ones finish side by side."""
    from textlab.operators import chains as CH
    return _threshold_tree(spark, sf, local_cells=50_000, peel_rows=CH.PEEL_ROWS)[0]


def q_tree_model_report(spark, sf):
    """M8 + A17: train the ML decision tree on 80 % of the labelled rows, report on the other 20 %."""
    from textlab.operators import train as TRN
    r = TRN.train(labeled(spark, sf), TRN.TrainParams(split_percent=TRAIN_PERCENT))
    return TRN.evaluate(spark, r.predictions)["report"]


# ----------------------------------------------------------------------------------- stream
STREAM_FILES = 4


def _stream_run(spark, sf, labels: bool = True, stats: bool = True):
    """Stage ``documents`` as arriving files, then run the labelling and/or statistics stream to the end."""
    from textlab.streaming import labeling as ST_
    docs = table(spark, sf, "documents")
    # arrivals are as many files as the table has partitions, so no task writes more than its share
    inbox = ST_.stage_inbox(docs, scratch_path(spark, "inbox"), max(STREAM_FILES, docs.rdd.getNumPartitions()))
    out = scratch_path(spark, "stream-out")
    vec, ev = table(spark, sf, "embeddings"), table(spark, sf, "events")
    if labels:
        q = ST_.run_labeling(spark, ST_.read_inbox(spark, inbox, docs.schema), out,
                             label=lambda batch: ST_.label_stream(batch, vec, ev, shipped_conf_rules()))
        q.awaitTermination()
    if stats:
        scored, columns = scratch_path(spark, "stream-scored"), ["sentiment", "confidence"]
        q = ST_.run_scoring(spark, ST_.read_inbox(spark, inbox, docs.schema), scored,
                            lambda batch: ST_.label_stream(batch, vec, ev), columns)
        q.awaitTermination()
        # the state has a key a class: with the usual number of partitions nearly all of them would be kept empty
        own = spark.newSession()
        own.conf.set("spark.sql.shuffle.partitions", str(len(S.SENTIMENTS)))
        rows = ST_.read_inbox(own, f"{scored}/*", "sentiment string, confidence double")
        ST_.run_running_stats(own, ST_.running_stats(rows), f"{out}/stats").awaitTermination()
    return out


def q_stream_sentiment_counts(spark, sf):
    """Running counts and mean confidence per sentiment from the document stream."""
    out = _stream_run(spark, sf, labels=False)
    st = spark.read.parquet(f"{out}/stats")
    return st.select("sentiment", "n", F.round("avg_confidence", 6).alias("avg_confidence"))


def q_stream_label_posts(spark, sf):
    """G1: rows labelled by the document stream."""
    out = _stream_run(spark, sf, stats=False)
    return spark.read.parquet(f"{out}/labeled").select("id", "sentiment", "confidence", "confidence_level")


def q_stream_label_csv(spark, sf):
    """G1 on post files: the labelled rows written as CSV part files (each one an arrival), labelled per
    micro-batch by the Python lexicon scorer and stored as three tables per batch; read back as the view."""
    from textlab.functions.scoring import lexicon_scorer
    from textlab.sources.store import load_view
    from textlab.streaming import labeling as ST_
    out = scratch_path(spark, "posts-stream-out")
    q = ST_.label_posts_stream(spark, _posts_csv(spark, sf), out, lexicon_scorer(POSITIVE_WORDS, NEGATIVE_WORDS),
                               columns=["id_str", "full_text", "favorite_count", "created_at", "location", "username"],
                               files_per_trigger=STREAM_FILES)
    q.awaitTermination()
    return load_view(spark, out).select("username", "sentiment", "confidence", "favorite_count")


def q_stream_progress_totals(spark, sf):
    """Totals of the stream's batch ledger."""
    from textlab.streaming import labeling as ST_
    led = ST_.batch_ledger(spark, _stream_run(spark, sf, stats=False))
    return led.agg(F.sum("rows").alias("rows"), F.sum("saved").alias("saved"), F.sum("skipped").alias("skipped"),
                   F.max("done").alias("done"), F.max("percent").alias("percent"))


# ----------------------------------------------------------------------------------- registry
QUERIES = {
    "clean_text": q_clean_text, "tokenize": q_tokenize, "remove_stopwords": q_remove_stopwords,
    "softmax_classify": q_softmax_classify, "label_posts": q_label_posts, "feature_score": q_feature_score,
    "path_rules": q_path_rules, "python_scorer": q_python_scorer, "label_csv": q_label_csv,
    "stem_text": q_stem_text, "csv_split_records": q_csv_split_records,
    "scan_posts": q_scan_posts, "scorable_posts": q_scorable_posts, "missing_columns": q_missing_columns,
    "preview_rows": q_preview_rows, "parse_created_at": q_parse_created_at, "import_defaults": q_import_defaults,
    "union_tagged": q_union_tagged,
    "confidence_tier": q_confidence_tier, "sentiment_category": q_sentiment_category, "popularity": q_popularity,
    "confidence_patterns": q_confidence_patterns, "likes_patterns": q_likes_patterns,
    "mine_confidence_rules": q_mine_confidence_rules, "rules_text": q_rules_text,
    "rules_roundtrip": q_rules_roundtrip, "rules_edges": q_rules_edges, "rules_nested": q_rules_nested,
    "import_append": q_import_append, "mixed_encodings": q_mixed_encodings,
    "sentiment_counts": q_sentiment_counts, "dataset_counts": q_dataset_counts, "sentiment_stats": q_sentiment_stats,
    "stats_grouping_sets": q_stats_grouping_sets, "dashboard_stats": q_dashboard_stats,
    "sentiment_distribution": q_sentiment_distribution, "confidence_histogram": q_confidence_histogram,
    "likes_boxplot": q_likes_boxplot, "distinct_labels": q_distinct_labels,
    "labeled_view": q_labeled_view, "labeled_limit": q_labeled_limit, "filter_by_sentiment": q_filter_by_sentiment,
    "normalize_texts": q_normalize_texts, "normalize_sentiments": q_normalize_sentiments,
    "normalize_metadata": q_normalize_metadata,
    "train_test_split": q_train_test_split, "split_preview": q_split_preview, "dataset_splits": q_dataset_splits,
    "split_join_train": q_split_join_train, "split_join_test": q_split_join_test, "split_summary": q_split_summary,
    "data_distribution": q_data_distribution, "test_distribution": q_test_distribution,
    "batch_progress": q_batch_progress,
    "top_terms": q_top_terms, "term_counts": q_term_counts, "tfidf": q_tfidf, "lemma_lookup": q_lemma_lookup,
    "confusion_matrix": q_confusion_matrix, "classification_report": q_classification_report,
    "accuracy": q_accuracy,
    "gain_ratio_root": q_gain_ratio_root, "gain_ratio_best": q_gain_ratio_best, "tree_nodes": q_tree_nodes,
    "tree_levels": q_tree_levels,
    "threshold_tree_levels": q_threshold_tree_levels,
    "threshold_tree_predict": q_threshold_tree_predict,
    "threshold_tree_rules": q_threshold_tree_rules,
    "threshold_tree_dot": q_threshold_tree_dot,
    "threshold_tree_nodes": q_threshold_tree_nodes,
    "tree_rules_text": q_tree_rules_text, "tree_edges": q_tree_edges,
    "tree_model_report": q_tree_model_report,
    "stream_sentiment_counts": q_stream_sentiment_counts, "stream_label_posts": q_stream_label_posts,
    "stream_progress_totals": q_stream_progress_totals, "stream_label_csv": q_stream_label_csv,
}
