"""Train, apply and evaluate the decision-tree classifier.

The training run is a chain of Spark jobs: split (W1), fit the feature stages on the training rows
only (vocabulary = top ``max_features`` terms, V1; optional TF-IDF with the ``+1`` idf and L2 norm,
V2), fit a ``DecisionTreeClassifier``, predict the test rows, aggregate the confusion matrix and
report (A16-A18) and persist the fitted pipeline with a registry row (K7). The only values brought to
the driver are bounded by the parameters: the vocabulary (``max_features`` strings), the idf vector
(same length) and the label list (the class domain).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, IDF, IndexToString, Normalizer,
                                RegexTokenizer, StopWordsRemover, StringIndexer)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab import schema as S
from textlab.functions.text import TOKEN_RE, english_stop_words
from textlab.operators import evaluate as EV
from textlab.operators.features import top_terms
from textlab.operators.split import train_test_split
from textlab.sources.scratch import materialize

# DecisionTreeClassifier refuses depths above 30; no limit given means the deepest tree it can grow.
MAX_TREE_DEPTH = 30
# The learner keeps every row as an array with a 4-byte bin per feature, and a task reads a partition of them on each level.
POINT_BYTES, PARTITION_BYTES = 4, 128 << 20


@dataclass
class TrainParams:
    """M8 parameters (split, tokenisation, vectorisation, tree), defaults as in the application."""
    split_percent: float = S.DEFAULT_TRAIN_PERCENT
    remove_stopwords: bool = True
    stop_words: list[str] | None = None          # None: Spark's English list
    vectorization: str = "count"                 # "count" or "tfidf"
    max_features: int = S.MAX_FEATURES
    max_depth: int | None = None
    criterion: str = "gini"                      # "gini" or "entropy"
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    seed: int = S.SPLIT_SEED
    log: list[tuple[str, str]] = field(default_factory=list)


def tree_params(p: TrainParams) -> dict:
    """M1 parameter mapping. What the learner cannot do is refused: a depth above 30, and a minimum number of rows to
    split other than 2 (a minimum per leaf is another thing). Without a depth the deepest possible tree is grown."""
    if p.max_depth is not None and int(p.max_depth) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {p.max_depth} is above {MAX_TREE_DEPTH}; textlab.operators.tree has no such limit")
    if int(p.min_samples_split) != 2:
        raise ValueError("min_samples_split other than 2 is not supported; use min_samples_leaf")
    depth = MAX_TREE_DEPTH if p.max_depth is None else int(p.max_depth)
    return {"maxDepth": depth, "impurity": p.criterion, "minInstancesPerNode": int(p.min_samples_leaf), "seed": p.seed}


def token_stages(p: TrainParams, text_col: str = "preprocessed_text") -> list:
    """T8 + T9 as ML stages: tokens of two or more word characters, then stop-word removal."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="tokens_all", pattern=TOKEN_RE, gaps=False,
                         toLowercase=False, minTokenLength=2)
    if not p.remove_stopwords:
        return [tok.setOutputCol("tokens")]
    stop = p.stop_words if p.stop_words is not None else english_stop_words()
    return [tok, StopWordsRemover(inputCol="tokens_all", outputCol="tokens", stopWords=stop, caseSensitive=True)]


def fit_features(train: DataFrame, p: TrainParams, text_col: str = "preprocessed_text") -> PipelineModel:
    """Fit the feature stages on the training rows; returns a ``PipelineModel`` producing ``features``.

    Vocabulary: the ``max_features`` most frequent training terms (ties by term), in alphabetical
    column order. TF-IDF: ``tf * (ln((1+n)/(1+df)) + 1)`` = ML's idf plus one, then L2 row norm.
    """
    stages = token_stages(p, text_col)
    tokenised = PipelineModel(stages=stages).transform(train)
    terms = (tokenised.select("id", F.explode("tokens").alias("term"))
             .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    vocab = top_terms(terms, p.max_features)
    words = [r[0] for r in vocab.orderBy("idx").select("term").collect()]   # <= max_features strings
    out_tf = "tf" if p.vectorization == "tfidf" else "features"
    cv = CountVectorizerModel.from_vocabulary(words, inputCol="tokens", outputCol=out_tf)
    stages = stages + [cv]
    if p.vectorization == "tfidf":
        idf_model = IDF(inputCol="tf", outputCol="_idf_unused").fit(cv.transform(tokenised))
        plus_one = Vectors.dense([x + 1.0 for x in idf_model.idf.toArray()])
        stages += [ElementwiseProduct(scalingVec=plus_one, inputCol="tf", outputCol="tf_idf"),
                   Normalizer(p=2.0, inputCol="tf_idf", outputCol="features")]
    return PipelineModel(stages=stages)


def spread_points(featurised: DataFrame, rows: int, features: int) -> DataFrame:
    """``featurised`` in so many partitions that none is above ``PARTITION_BYTES`` as the learner keeps it.

    A partition of sparse vectors, or of the texts they come from, is much smaller than the arrays made of it."""
    wanted = math.ceil(rows * features * POINT_BYTES / PARTITION_BYTES)
    return featurised.repartition(wanted) if wanted > featurised.rdd.getNumPartitions() else featurised


def fit_classifier(featurised: DataFrame, p: TrainParams, label_col: str = "sentiment") -> PipelineModel:
    """M1 + M4: index labels (alphabetical), fit the tree, map predictions back to label strings."""
    indexer = StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc",
                            handleInvalid="keep").fit(featurised)
    # deep trees: node ids cached per row and checkpointed every 10 levels into the session's shared
    # checkpoint folder, so lineage stays short and a lost executor does not restart the fit
    dt = DecisionTreeClassifier(featuresCol="features", labelCol="label_idx", predictionCol="pred_idx",
                                cacheNodeIds=True, checkpointInterval=10, **tree_params(p))
    tree = dt.fit(indexer.transform(featurised))
    back = IndexToString(inputCol="pred_idx", outputCol="predicted", labels=indexer.labels)
    return PipelineModel(stages=[indexer, tree, back])


@dataclass
class TrainResult:
    model: PipelineModel
    train_rows: int
    test_rows: int
    n_features: int
    predictions: DataFrame           # test rows: id, actual, predicted
    log: list[tuple[str, str]]


def train(df: DataFrame, p: TrainParams | None = None, id_col: str = "id", text_col: str = "preprocessed_text",
          label_col: str = "sentiment") -> TrainResult:
    """M8: split, fit features and tree on the training rows, predict the test rows.

    The split is materialised once (a Parquet table in the shared checkpoint folder) so fit and
    predict read the same rows even if a task is recomputed.
    """
    p = p or TrainParams()
    log = p.log
    data = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("preprocessed_text"),
                     F.col(label_col).alias("sentiment"))
    split = materialize(train_test_split(data, "id", p.split_percent, p.seed), "train-split")
    train_df = split.filter(F.col("split_type") == "train")
    test_df = split.filter(F.col("split_type") == "test")
    counts = split.groupBy("split_type").count().collect()          # two rows
    n = {r[0]: r[1] for r in counts}
    log.append(("split", f"train {n.get('train', 0)} rows, test {n.get('test', 0)} rows"))
    feats = fit_features(train_df, p)
    n_feat = len(feats.stages[[i for i, s in enumerate(feats.stages)
                               if isinstance(s, CountVectorizerModel)][0]].vocabulary)
    log.append(("vectorize", f"{p.vectorization}, {n_feat} features"))
    points = feats.transform(train_df).select("sentiment", "features")
    clf = fit_classifier(spread_points(points, n.get("train", 0), n_feat), p)
    model = PipelineModel(stages=feats.stages + clf.stages)
    log.append(("train", f"decision tree, {tree_params(p)}"))
    pred = model.transform(test_df).select("id", F.col("sentiment").alias("actual"), "predicted")
    return TrainResult(model, n.get("train", 0), n.get("test", 0), n_feat, pred, log)


def evaluate(spark: SparkSession, predictions: DataFrame, labels: list[str] = S.SENTIMENTS) -> dict[str, DataFrame]:
    """A16-A18 over a prediction table: confusion matrix, report and accuracy (all aggregations)."""
    cm = EV.confusion_matrix(spark, predictions, labels=labels)
    return {"confusion": cm, "report": EV.classification_report(cm), "accuracy": EV.accuracy(predictions)}


def predict(model: PipelineModel, df: DataFrame, text_col: str = "preprocessed_text") -> DataFrame:
    """Apply a fitted pipeline; ``predicted`` is the label string."""
    x = df if text_col == "preprocessed_text" else df.withColumn("preprocessed_text", F.col(text_col))
    if "sentiment" not in x.columns:
        x = x.withColumn("sentiment", F.lit(S.SENTIMENTS[0]))   # the indexer needs the column, not its value
    out = model.transform(x.withColumn("preprocessed_text", F.coalesce("preprocessed_text", F.lit(""))))
    return out.drop("tokens_all", "tokens", "tf", "tf_idf", "features", "label_idx", "rawPrediction",
                    "probability", "pred_idx")


def tree_summary(model: PipelineModel) -> dict:
    """M7 for the ML tree: depth and node count."""
    from pyspark.ml.classification import DecisionTreeClassificationModel
    t = [s for s in model.stages if isinstance(s, DecisionTreeClassificationModel)][0]
    return {"depth": t.depth, "num_nodes": t.numNodes}
