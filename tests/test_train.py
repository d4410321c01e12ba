"""The trained pipeline, its invariants and a registry round trip."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlab import schema as S
from textlab.operators import train as TR
from textlab.sources import store as ST
from textlab.sources.tables import labeled


@pytest.fixture(scope="module")
def trained(spark):
    lab = labeled(spark, SF_SMALL)
    return lab, TR.train(lab, TR.TrainParams(max_features=300))


def test_split_sizes_and_domain(spark, trained):
    lab, r = trained
    n = lab.count()
    assert r.train_rows == int(n * 80 / 100) and r.train_rows + r.test_rows == n
    assert 0 < r.n_features <= 300
    preds = r.predictions.collect()
    assert len(preds) == r.test_rows
    assert {p.predicted for p in preds} <= set(S.SENTIMENTS)


def test_training_accuracy_beats_majority(spark, trained):
    lab, r = trained
    pred = TR.predict(r.model, lab.select("id", "preprocessed_text", "sentiment"))
    acc = pred.agg(F.avg((F.col("predicted") == F.col("sentiment")).cast("double"))).first()[0]
    majority = lab.groupBy("sentiment").count().agg(F.max("count")).first()[0] / lab.count()
    assert acc >= majority


def test_report_consistent_with_predictions(spark, trained):
    _lab, r = trained
    ev = TR.evaluate(spark, r.predictions)
    assert ev["confusion"].agg(F.sum("n")).first()[0] == r.test_rows
    rep = {x["class"]: x for x in ev["report"].collect()}
    assert rep["accuracy"].f1 == ev["accuracy"].first().accuracy


def test_tfidf_vectorization_rows_are_unit_length(spark):
    lab = labeled(spark, SF_SMALL)
    p = TR.TrainParams(vectorization="tfidf", max_features=200)
    feats = TR.fit_features(lab, p)
    import numpy as np
    rows = feats.transform(lab).select("features").collect()
    norms = [float(np.linalg.norm(r.features.toArray())) for r in rows]
    assert all(abs(x - 1.0) < 1e-9 or x == 0.0 for x in norms)


def test_tree_params_mapping():
    p = TR.TrainParams(max_depth=None, min_samples_leaf=3, criterion="entropy")
    assert TR.tree_params(p) == {"maxDepth": 30, "impurity": "entropy", "minInstancesPerNode": 3, "seed": 42}
    for wrong in ({"max_depth": 31}, {"min_samples_split": 5}):
        with pytest.raises(ValueError):
            TR.tree_params(TR.TrainParams(**wrong))


def test_registry_roundtrip(spark, trained, tmp_path):
    lab, r = trained
    base = str(tmp_path / "models")
    name = ST.model_name()
    assert name.startswith("sentiment_model_")
    ST.save_model(spark, base, name, r.model, 0.5)
    ST.save_model(spark, base, name, r.model, 0.75)            # upsert by name
    model, acc = ST.get_model(spark, base, name)
    assert acc == 0.75
    assert ST.get_model(spark, base, "absent") is None
    x = lab.select("id", "preprocessed_text").limit(50)
    a = TR.predict(r.model, x).select("id", "predicted").orderBy("id").collect()
    b = TR.predict(model, x).select("id", "predicted").orderBy("id").collect()
    assert a == b


def test_no_partition_of_the_learner_is_too_large(spark, monkeypatch):
    from textlab.operators import train as TRN
    rows = [(k, f"alpha beta{k % 3} gamma{k % 5}", ["negative", "neutral", "positive"][k % 3]) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, preprocessed_text string, sentiment string").coalesce(1)
    before = sorted(tuple(r) for r in TRN.train(df).predictions.collect())
    monkeypatch.setattr(TRN, "PARTITION_BYTES", 400)
    sizes = TRN.spread_points(df, 120, 9).rdd.glom().map(len).collect()
    assert len(sizes) == 11 and max(sizes) * 9 * TRN.POINT_BYTES <= 2 * 400
    assert sorted(tuple(r) for r in TRN.train(df).predictions.collect()) == before
