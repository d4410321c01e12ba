"""Scoring: class logits -> sentiment and confidence (P1), linear feature score (P6), path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.schema import SENTIMENTS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits) -> Column:
    """Numerically stable softmax of an ``array<double>`` with higher-order functions (no UDF)."""
    lg = _col(logits)
    m = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - m))
    s = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / s)


def classify(probs, labels: list[str] = SENTIMENTS) -> Column:
    """Arg-max class (first index wins ties) and its probability, as ``struct<sentiment, confidence>``."""
    p = _col(probs)
    mx = F.array_max(p)
    idx = F.array_position(p, mx)
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), idx.cast("int"))
    return F.struct(lab.alias("sentiment"), mx.alias("confidence"))


def feature_score(weights: list[tuple[str, float]]) -> Column:
    """Weighted sum of feature columns, in the weights' stored order (missing features count 0)."""
    total = F.lit(0.0)
    for name, w in weights:
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return total


_OPS = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "=": lambda a, b: a == b,
        "!=": lambda a, b: a != b}


def path_rules(rules: list[tuple[int, list[tuple[str, str, float]], str]]) -> Column:
    """First rule (by stored order) whose predicates all hold gives the label; none -> null.

    The rule list is small and known on the driver, so it compiles to one ``CASE WHEN`` chain.
    """
    out = None
    for _node, path, label in rules:
        cond = F.lit(True)
        for feat, op, thr in path:
            cond = cond & _OPS[op](F.col(feat).cast("double"), F.lit(float(thr)))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out if out is not None else F.lit(None).cast("string")


def path_rules_node(rules) -> Column:
    """Node id of the first matching path rule (same order as :func:`path_rules`)."""
    out = None
    for node, path, _label in rules:
        cond = F.lit(True)
        for feat, op, thr in path:
            cond = cond & _OPS[op](F.col(feat).cast("double"), F.lit(float(thr)))
        out = F.when(cond, F.lit(node)) if out is None else out.when(cond, F.lit(node))
    return out if out is not None else F.lit(None).cast("int")


# ---------------------------------------------------------------------------------------------- P2
def score_with(df, make_scorer, text_col: str = "preprocessed_text", id_col: str = "id", keep: list[str] | None = None):
    """Class logits from a Python scorer, run over Arrow batches with ``mapInPandas``.

    ``make_scorer()`` is called once per task (load a model there, not per row) and returns a function
    ``list[str] -> list[list[float]]``. If a batch fails, its rows are retried one by one and a row
    that still fails gets null logits and its message in ``_error`` (F3), so one bad row never drops
    the batch. The result keeps ``id``, ``text_col`` and the ``keep`` columns (passed through the same
    Arrow batch, so no join back is needed).
    """
    import pandas as pd
    from pyspark.sql import types as T

    cols = [id_col, text_col] + [c for c in (keep or []) if c not in (id_col, text_col)]

    def run(batches):
        scorer = make_scorer()
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            errors = [None] * len(texts)
            try:
                logits = [list(map(float, x)) for x in scorer(texts)]
            except Exception:  # noqa: BLE001 - isolate the failing rows
                logits = []
                for i, t in enumerate(texts):
                    try:
                        logits.append([float(x) for x in scorer([t])[0]])
                    except Exception as ex:  # noqa: BLE001
                        logits.append(None)
                        errors[i] = f"{type(ex).__name__}: {ex}"[:500]
            out = pdf[cols].copy()
            out["logits"] = logits
            out["_error"] = errors
            yield out

    base = df.select(*cols)
    schema = T.StructType(base.schema.fields + [T.StructField("logits", T.ArrayType(T.DoubleType())),
                                                T.StructField("_error", T.StringType())])
    return base.mapInPandas(run, schema)


def classify_logits(df, logits_col: str = "logits"):
    """P1 after P2: probabilities, sentiment and confidence (6 decimals) from a logits column."""
    x = df.withColumn("probs", softmax(logits_col))
    cls = classify("probs")
    return x.withColumn("sentiment", cls["sentiment"]).withColumn("confidence", F.round(cls["confidence"], 6))


def lexicon_scorer(positive: list[str], negative: list[str], neutral_bias: float = 1.0):
    """A small scorer factory for P2: logits ``[#negative words, bias, #positive words]`` per text."""
    def make():
        pos, neg = frozenset(positive), frozenset(negative)

        def score(texts):
            out = []
            for t in texts:
                words = t.split(" ") if t else []
                out.append([float(sum(w in neg for w in words)), neutral_bias, float(sum(w in pos for w in words))])
            return out
        return score
    return make
