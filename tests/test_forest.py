"""Forests tuned with one fit for all depths: the library's metrics and predictions, with fewer fits."""

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, TrainValidationSplit

from casebase import FeatureSpec
from casebase.plans import baselines as B

SPEC = FeatureSpec("id", "label", ("f", "g"), ("x",))
GRID = {"numTrees": (1, 3, 7), "maxDepth": (1, 2, 4, 6), "maxBins": (40,), "impurity": ("gini", "entropy")}


@pytest.fixture(scope="module")
def cases(spark):
    draw = random.Random(3)
    rows = []
    for i in range(900):
        f, g, x = draw.choice("abcd"), draw.choice("pqrstuvwxyz0123456789"), draw.gauss(0, 3)
        sure = "PNZ"[(ord(f) + int(x > 0.5) + (g in "prtv56")) % 3]
        rows.append((i, f, g, x, sure if draw.random() < 0.7 else draw.choice("PNZ")))
    return spark.createDataFrame(rows, "id long, f string, g string, x double, label string").repartition(3, "id").cache()


def _library(cases, tuner):
    tr, te, labels = B._prepare(cases, cases, SPEC)
    tr = tr.select("label_idx", "features").persist()
    rf = RandomForestClassifier(labelCol="label_idx", featuresCol="features", seed=10)
    maps = B._rf_grid(rf, GRID)
    fitted = tuner(estimator=rf, estimatorParamMaps=maps, parallelism=4, seed=10,
                   evaluator=MulticlassClassificationEvaluator(labelCol="label_idx")).fit(tr)
    return B._predictions(fitted.bestModel, te, labels, SPEC), fitted


@pytest.mark.parametrize("kind", ["cv", "tvs"])
def test_metrics_and_predictions_are_the_librarys(spark, cases, monkeypatch, kind):
    if kind == "cv":
        want, fitted = _library(cases, lambda **o: CrossValidator(numFolds=3, **o))
        metrics = fitted.avgMetrics
    else:
        want, fitted = _library(cases, lambda **o: TrainValidationSplit(trainRatio=0.75, **o))
        metrics = fitted.validationMetrics
    fits, plain = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda rf, df: fits.append(1) or plain(rf, df))
    got, report = (B.random_forest_cv(cases, cases, SPEC, GRID, folds=3) if kind == "cv"
                   else B.random_forest_tvs(cases, cases, SPEC, GRID))
    assert len(fits) == 6 * (3 if kind == "cv" else 1) + 1             # not one a depth
    assert [r.avg_metric for r in report.collect()] == pytest.approx(list(metrics), abs=1e-12)
    assert len(set(round(m, 9) for m in metrics)) > 12                 # the depths differ
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_depths_beyond_the_librarys_memory_are_fitted_alone(spark):
    rf = RandomForestClassifier(maxMemoryInMB=1)
    maps = B._rf_grid(rf, {"numTrees": (2, 50), "maxDepth": (2, 9), "maxBins": (32,)})
    runs = B._depths(rf, maps, 3, 3)
    assert sorted(sorted(points) for _, points in runs) == [[2], [2], [9], [9]]
    runs = B._depths(rf.copy({rf.maxMemoryInMB: 256}), maps, 3, 3)
    assert sorted(sorted(points) for _, points in runs) == [[2, 9], [2, 9]]
    assert all(pm[rf.maxDepth] == 9 for pm, _ in runs)
