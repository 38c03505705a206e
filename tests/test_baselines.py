"""The tuned learners: best point of the report, repeatable, classes, metrics."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from casebase import FeatureSpec
from casebase.operators import evaluate as E
from casebase.plans import baselines as B
from casebase.plans import jobs

SF = "/root/testdata/sf0.001"
GRID = {"numTrees": (2, 5), "maxDepth": (2, 3), "maxBins": (30,), "impurity": ("gini",)}


@pytest.fixture(scope="module")
def sides(spark):
    return jobs.sides(spark, SF, "docs")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("fit", [
    lambda tr, te, s: B.random_forest_cv(tr, te, s, GRID, folds=2),
    lambda tr, te, s: B.random_forest_tvs(tr, te, s, GRID)])
def test_tuned_forest(spark, sides, fit):
    spec, train, test = sides
    pred, report = fit(train, test, spec)
    rows = report.collect()
    assert {(r.num_trees, r.max_depth) for r in rows} == {(a, b) for a in (2, 5) for b in (2, 3)}
    assert all(0 <= r.avg_metric <= 1 for r in rows)
    got = _rows(pred)
    assert [r[0] for r in got] == sorted(r.doc_id for r in test.collect())      # one a test row
    again, report2 = fit(train, test, spec)
    assert _rows(again) == got and _rows(report2) == _rows(report)              # bit for bit
    best = max(rows, key=lambda r: r.avg_metric)
    alone = {"numTrees": (best.num_trees,), "maxDepth": (best.max_depth,), "maxBins": (30,),
             "impurity": ("gini",)}
    assert _rows(B.random_forest_cv(train, test, spec, alone, folds=2)[0]) == got


def test_logistic_has_the_training_classes(spark):
    spec = FeatureSpec("id", "label", ("f",), ("x",))
    df = spark.createDataFrame([(i, "abc"[i % 3], float(i % 7), "PN"[i % 2]) for i in range(60)],
                               "id long, f string, x double, label string")
    tr, _, labels = B._prepare(df, df, spec)
    m = LogisticRegression(labelCol="label_idx", featuresCol="features").fit(tr)
    assert m.numClasses == len(labels) == 2
    test = df.withColumn("label", F.when(F.col("id") == 3, "new").otherwise(F.col("label")))
    test = test.withColumn("f", F.when(F.col("id") == 4, "unseen").otherwise(F.col("f")))
    pred = B.logistic(df, test, spec).collect()
    assert len(pred) == 60 and {r.prediction for r in pred} <= {"P", "N"}
    with_null = df.withColumn("label", F.when(F.col("id") % 5 > 0, F.col("label")))
    assert B.naive_bayes(with_null, df, spec).count() == 60


def test_metrics_equal_the_evaluator(spark, sides):
    spec, train, test = sides
    pred = B.logistic(train, test, spec)
    ours = E.metrics(pred).first()
    as_double = pred.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
    for name, value in (("accuracy", ours.weighted_recall), ("f1", ours.weighted_f1),
                        ("weightedPrecision", ours.weighted_precision),
                        ("weightedFalsePositiveRate", ours.weighted_fpr)):
        assert MulticlassClassificationEvaluator(metricName=name).evaluate(as_double) == pytest.approx(
            value, abs=1e-8)
