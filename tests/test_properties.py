"""Metric and search properties on driver tables (sf0.001) and random fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebase import CaseModel
from casebase.functions.kernels import topk_per_row
from casebase.operators.neighbors import nearest, nearest_within
from casebase.operators.topk import blocked_topk
from casebase.plans import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    spec, train, test = jobs.sides(spark, SF, "docs")
    return spec, train, test, CaseModel.fit(train, spec)


def test_vdm_range_and_renaming(spark, docs):
    spec, train, _, m = docs
    v = {(r.feature, r.v1, r.v2): r.vdm for r in m.vdm().collect()}
    assert all(0.0 <= x <= 2.0 for x in v.values())
    renamed = train.withColumn("lang", F.concat(F.lit("L_"), "lang"))
    v2 = {(r.feature, r.v1.replace("L_", ""), r.v2.replace("L_", "")): r.vdm
          for r in CaseModel.fit(renamed, spec).vdm().collect()}
    assert v == v2


def test_distance_symmetric_and_zero_to_self(spark, docs):
    spec, train, _, m = docs
    nb = nearest(train, m, 3).where("rank = 1").collect()
    assert all(r.distance == 0.0 for r in nb)           # a case is its own nearest (id tie-break)
    a = {(r.query_id, r.case_id): r.distance for r in nearest(train, m, 400).collect()}
    assert all(a[(j, i)] == d for (i, j), d in a.items())


def test_topk_independent_of_grid(spark, docs):
    spec, train, test, m = docs
    base = sorted(tuple(r) for r in nearest(test, m, 5).collect())
    left = test.select(F.col(spec.id).alias("query_id"), *spec.order)
    right = m.cases.select(F.col(spec.id).alias("case_id"), *spec.order)
    for lrows, rrows in [(7, 11), (1, 3), (10_000, 10_000)]:
        got = blocked_topk(left, right, left_key=["query_id"], right_key=["case_id"], k=5,
                           kernel=m.metric.kernel, attach=m.metric.attach, left_block_rows=lrows, right_block_rows=rrows,
                           min_groups=1)
        got = sorted(tuple(r) for r in got.select("query_id", "rank", "case_id", "distance")
                     .collect())
        assert got == base


def test_shuffle_partitions_do_not_change_results(spark, docs):
    spec, train, test, m = docs
    res = []
    for n in (1, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        res.append(sorted(tuple(r) for r in nearest(test, m, 5).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]


def test_rule_count(spark, docs):
    spec, train, _, m = docs
    n = train.count()
    assert nearest_within(m, 3).count() == n * 3


def test_topk_per_row_matches_sort():
    rng = np.random.default_rng(7)
    d = rng.integers(0, 4, size=(50, 40)).astype(float)     # many ties
    rows, cols, vals, rank = topk_per_row(d, 6)
    for i in range(50):
        want = sorted(range(40), key=lambda j: (d[i, j], j))[:6]
        assert list(cols[rows == i]) == want
        assert list(rank[rows == i]) == list(range(1, 7))


def test_fewer_candidates_than_k(spark, micro):
    from casebase import FeatureSpec
    spec = FeatureSpec("id", "label", ("f1", "f2"), ("f3",))
    m = CaseModel.fit(micro[0].limit(3), spec)
    assert nearest(micro[1], m, 10).count() == 3 * 3


def test_profile_search_equals_plain_search(spark):
    """Compressed (profile) search returns exactly the plain search's rows."""
    from casebase.operators.classify import adapt_classify
    spec, train, test = jobs.sides(spark, SF, "ord")
    plain = CaseModel.fit(train, spec, radius=3, compress=False)
    prof = CaseModel.fit(train, spec, radius=3, compress=True)
    for f in (lambda m: nearest(test, m, 5), lambda m: nearest_within(m, 3),
              lambda m: m.rules, lambda m: adapt_classify(test, m, 5, 5)):
        assert sorted(tuple(r) for r in f(plain).collect()) == \
            sorted(tuple(r) for r in f(prof).collect())


def test_one_nn_returns_own_label_on_distinct_rows(spark):
    """Classifying the training rows themselves with k=1 returns their labels
    when no two training rows share a feature vector (own distance is 0)."""
    from casebase.operators.classify import knn_classify
    spec, train, _ = jobs.sides(spark, SF, "cust")
    m = CaseModel.fit(train, spec)
    rows = knn_classify(train, m, 1).collect()
    assert rows and all(r.label == r.prediction for r in rows)


def test_weighted_recall_equals_accuracy(spark):
    from casebase.operators import evaluate as E
    from casebase.operators.classify import knn_classify
    spec, train, test = jobs.sides(spark, SF, "docs")
    pred = knn_classify(test, CaseModel.fit(train, spec), 5)
    m = E.metrics(pred).collect()[0]
    acc = sum(r.label == r.prediction for r in pred.collect()) / m.n_test
    assert m.weighted_recall == round(acc, 9) == m.weighted_tpr
    assert m.error_rate == round(1 - acc, 9)


def test_repetition_key_equals_separate_runs(spark):
    """Hold-out with rep as a key gives, for every rep, the single-split result."""
    from casebase.functions.splits import is_train
    from casebase.operators import evaluate as E
    from casebase.operators.classify import adapt_classify
    from casebase.plans.experiment import holdout
    from casebase.sources import casebases as CB
    spec, cases = CB.docs(spark, SF)
    keyed = {r.rep: r for r in holdout(cases, spec, "adapt", reps=3).collect()}
    for rep in range(3):
        t = is_train(spec.id, rep)
        m = CaseModel.fit(cases.where(t), spec, radius=3)
        single = E.metrics(adapt_classify(cases.where(~t), m, 5, 5)).collect()[0]
        got = keyed[rep]
        assert (got.n_test, got.n_errors, got.weighted_f1) == \
            (single.n_test, single.n_errors, single.weighted_f1)


def test_profile_search_keeps_null_values(spark):
    """A NULL categorical value is its own value in both search paths."""
    from casebase import FeatureSpec
    spec = FeatureSpec("id", "label", ("f1", "f2"))
    train = spark.createDataFrame(
        [(0, "a", "x", "P"), (1, None, "y", "P"), (2, "b", None, "N"), (3, None, "y", "N"),
         (4, "c", "x", "P"), (5, "b", "y", "N"), (6, "a", None, "P"), (7, None, None, "N")],
        "id long, f1 string, f2 string, label string")
    q = spark.createDataFrame([(100, None, "y", "P"), (101, "b", None, "N"), (102, "z", "x", "P")],
                              "id long, f1 string, f2 string, label string")
    plain = CaseModel.fit(train, spec, compress=False)
    prof = CaseModel.fit(train, spec, compress=True)
    key = lambda r: tuple("" if v is None else v for v in r)
    a = sorted((tuple(r) for r in nearest(q, plain, 3).collect()), key=key)
    b = sorted((tuple(r) for r in nearest(q, prof, 3).collect()), key=key)
    assert a == b and len(a) == 9
    # SQL semantics: NULL is at 1.0 from everything, NULL included
    d = {(r.query_id, r.case_id): r.distance for r in nearest(q, plain, 8).collect()}
    assert d[(101, 7)] == d[(101, 1)]      # f2: NULL vs NULL and NULL vs y are both 1.0
