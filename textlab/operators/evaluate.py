"""Evaluation (A16-A18): confusion matrix, classification report and accuracy as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab import schema as S


def confusion_matrix(spark: SparkSession, df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     labels: list[str] = S.SENTIMENTS) -> DataFrame:
    """``(actual, predicted, n)`` zero-filled over the label grid (labels^2 rows, a literal table)."""
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def classification_report(cm: DataFrame) -> DataFrame:
    """Precision / recall / F1 / support per class, plus accuracy, macro and weighted averages.

    Works on the confusion table (labels^2 rows); 0 where a denominator is 0.
    """
    tp = cm.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("pred_n"))
    x = tp.join(sup, "cls").join(pred, "cls")
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    x = x.select("cls", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    x = x.withColumn("f1", f1)
    allw = Window.partitionBy()
    total = F.sum("support").over(allw)
    x = x.withColumn("total", total).withColumn("tp_all", F.sum("tp").over(allw))
    per = x.select("cls", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"))
    macro = x.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                  F.sum("support").cast("bigint").alias("support"))
    wsum = F.sum("support")
    weighted = x.agg(F.lit("weighted avg").alias("cls"),
                     F.coalesce(F.try_divide(F.sum(F.col("precision") * F.col("support")), wsum), F.lit(0.0)).alias("precision"),
                     F.coalesce(F.try_divide(F.sum(F.col("recall") * F.col("support")), wsum), F.lit(0.0)).alias("recall"),
                     F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), wsum), F.lit(0.0)).alias("f1"),
                     wsum.cast("bigint").alias("support"))
    acc = x.agg(F.lit("accuracy").alias("cls"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                F.coalesce(F.try_divide(F.sum("tp").cast("double"), F.sum("support")), F.lit(0.0)).alias("f1"),
                F.sum("support").cast("bigint").alias("support"))
    out = per.unionByName(macro).unionByName(weighted).unionByName(acc)
    return out.select(F.col("cls").alias("class"), F.round("precision", 6).alias("precision"),
                      F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Share of rows whose prediction equals the truth."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.round(F.avg((F.col(actual) == F.col(predicted)).cast("double")), 6).alias("accuracy"))
