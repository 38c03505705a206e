"""Laws of small and missing input: spreads, NULL labels, lost queries, run times."""

import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from casebase import CaseModel, FeatureSpec
from casebase.operators import evaluate as E
from casebase.operators import stats
from casebase.operators.classify import adapt_classify, knn_classify
from casebase.plans import experiment as X
from casebase.sources import sinks

SPEC = FeatureSpec("id", "label", ("f",), ("x",))
SCHEMA = "id long, f string, x double, label string, rep int"


def _spreads(df, by=()):
    return {tuple(r[b] for b in by): r.sigma for r in stats.sigma(df, SPEC, by).collect()}


def test_spread_of_missing_and_few_numbers(spark):
    nan = float("nan")
    rows = [(1, "a", 1.0, "P", 0), (2, "a", nan, "P", 0), (3, "b", None, "N", 0), (4, "b", 4.0, "N", 0),
            (5, "a", 2.0, "P", 1), (6, "a", None, "P", 2), (7, "a", nan, "P", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = _spreads(df, ["rep"])
    assert got == {(0,): pytest.approx(2.121320344, rel=1e-9), (1,): None, (2,): None, (3,): None}
    assert _spreads(df) == {(): pytest.approx(1.527525232, rel=1e-9)}
    assert _spreads(df.limit(0).union(df.where("id = 1"))) == {(): None}


@pytest.mark.parametrize("rows", [
    [(1, "a", 1.0, "P", 0)],
    [(1, "a", None, "P", 0), (2, "b", None, "N", 0), (3, "a", None, "P", 0)],
    [(1, "a", 1.0, "P", 0), (2, "b", 2.0, "N", 0), (3, "a", float("nan"), "P", 0), (4, "b", 2.5, "N", 1)]])
def test_fit_and_classify_without_a_spread(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    model = CaseModel.fit(df, SPEC, radius=1)
    assert [r.prediction for r in knn_classify(df.where("id = 1"), model, 1).collect()] == ["P"]
    assert adapt_classify(df, model, 2, 1).count() == len(rows)
    by = CaseModel.fit(df, SPEC, by=["rep"])               # a repetition of one row
    assert knn_classify(df, by, 1).count() == len(rows)


def test_null_labels_are_errors_everywhere(spark):
    df = spark.createDataFrame([(1, None, "P"), (2, "P", "P"), (3, "N", None), (4, None, None)],
                               "query_id long, label string, prediction string")
    count, whole = E.error_count(df).first(), E.metrics(df).first()
    assert (count.n_test, count.n_errors) == (whole.n_test, whole.n_errors) == (4, 3)
    assert E.error_rate(df).first().error_rate == whole.error_rate == 0.75


def test_sweep_counts_every_query(spark):
    """Cases without labels can't vote: their queries are wrong, not left out."""
    rows = [(i, "ab"[i % 2], float(i % 5), None if i % 2 else "P", 0) for i in range(40)]
    got = X.sweep(spark.createDataFrame(rows, SCHEMA), SPEC, [1], [1], [1], folds=4).collect()
    assert len(got) == 1 and 0.4 <= got[0].mean_error <= 1.0


def test_methods_over_the_same_splits(spark):
    rows = [(i, "ab"[i % 2], float(i % 7), "PN"[i % 2], 0) for i in range(60)]
    cases = spark.createDataFrame(rows, SCHEMA)
    got = X.compare(cases, SPEC, ["knn", "adapt", "nb"], reps=2, k=3, rno=3, radius=2).collect()
    assert {(r.method, r.rep) for r in got} == {(m, i) for m in ("knn", "adapt", "nb") for i in range(2)}
    sizes = {r.rep: r.n_test for r in got}
    assert all(r.n_test == sizes[r.rep] for r in got)


def test_end_is_after_the_work(spark, tmp_path):
    slow = spark.range(1).select(F.udf(lambda x: time.sleep(3) or x, "long")("id").alias("rep"))
    started = datetime.now(timezone.utc)
    sinks.write_results(slow, str(tmp_path / "r"), "parquet", "run", started)
    row = sinks.read_results(spark, str(tmp_path / "r"), "parquet").first()
    assert (row.ended - row.started).total_seconds() >= 3 and row.rep == 0
