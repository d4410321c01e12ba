"""JSON and text artefacts (S8, S9, K8, K9): nested samples, evaluation / training reports, rule text.

All writes are done by executors (``DataFrame.write``); the report frames are small aggregates, the
nested-sample reader explodes the array in the scan's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab import schema as S

NESTED_SAMPLES = ("data array<struct<text:string, metrics:struct<likes:int, dislikes:int>, sentiment:string>>")


def read_nested_samples(spark: SparkSession, path: str) -> DataFrame:
    """``{"data": [{"text", "metrics": {"likes", "dislikes"}, "sentiment"}]}`` as one row per sample.

    ``pos`` keeps the element's position in the file (the order the samples were written in).
    """
    raw = spark.read.option("multiLine", True).schema(NESTED_SAMPLES).json(path)
    x = raw.select(F.posexplode("data").alias("pos", "d"))
    return x.select("pos", F.col("d.text").alias("text"), F.col("d.metrics.likes").alias("likes"),
                    F.col("d.metrics.dislikes").alias("dislikes"), F.col("d.sentiment").alias("sentiment"))


def evaluation_report(confusion: DataFrame, report: DataFrame, labels: list[str] = S.SENTIMENTS) -> DataFrame:
    """K8 shape of an evaluation: one row with the label list, the matrix (rows = true class) and the report.

    Built from the ``labels^2``-row confusion table and the few report rows (bounded aggregates).
    """
    order = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    cm = confusion.select(order[F.col("actual")].alias("a"), order[F.col("predicted")].alias("p"), "n")
    rows = cm.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("cells"))
    matrix = rows.agg(F.array_sort(F.collect_list(F.struct("a", F.transform("cells", lambda c: c["n"]).alias("r"))))
                      .alias("m")).select(F.transform("m", lambda x: x["r"]).alias("confusion_matrix"))
    rep = report.agg(F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))
                     .alias("classification_report"))
    return (matrix.withColumn("_k", F.lit(1)).join(rep.withColumn("_k", F.lit(1)), "_k").drop("_k")
            .withColumn("labels", F.array(*[F.lit(x) for x in labels])))


def write_json(df: DataFrame, path: str) -> None:
    """K8: a report frame as JSON lines (one file per partition; reports are one partition)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A stored JSON report, or None when the folder does not exist."""
    try:
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.json(path)
    except Exception as ex:  # noqa: BLE001 - only a missing path means "absent"
        if "PATH_NOT_FOUND" in str(ex) or "does not exist" in str(ex):
            return None
        raise


def write_lines(lines: DataFrame, path: str, order: list[str], col: str = "line") -> None:
    """K9: ordered text lines (rules or tree text) as a text file set; the sort keeps the reading order
    across part files."""
    lines.orderBy(*order).select(col).write.mode("overwrite").text(path)
