"""The search on number lines gives the rows of the plain search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebase.functions.line import LineKernel
from casebase.operators import line
from casebase.operators.line import line_search
from casebase.operators.metric import Metric
from casebase.operators.stats import joint_counts, sigma
from casebase.operators.topk import blocked_topk
from casebase.spec import FeatureSpec

SPEC = FeatureSpec("id", "label", ("f", "g"), ("x",), order=("f", "x", "g"))
SCHEMA = "id long, label string, f string, g string, x double, cls string"


def _cases(spark, n, seed, number, first=0):
    rng = np.random.default_rng(seed)
    pick = lambda values: [None if v == "-" else v for v in rng.choice(list(values), n)]
    rows = zip(range(first, first + n), pick("ABC"), pick("pqrs-"), pick("uv"), map(number, rng.normal(size=n)),
               pick("KLL-"), strict=True)
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def _missing(v):
    return None if v > 1.2 else float("nan") if v < -1.4 else float("inf") if 1.1 < v else float(round(v, 1))


NUMBERS = {"spread": float, "ties": lambda v: float(round(v)), "constant": lambda v: 7.0, "missing": _missing,
           "far": lambda v: float(v * 1e6 if v > 1.5 else v), "near": lambda v: 1.0 + 1e-14 * int(v * 5)}


@pytest.mark.parametrize(("number", "slab_rows", "eq", "exclude"), [
    ("spread", 10_000, [], False), ("spread", 40, ["cls"], True), ("ties", 40, [], True),
    ("constant", 40, ["cls"], False), ("missing", 40, [], False), ("missing", 10_000, ["cls"], True),
    ("far", 40, [], False), ("near", 40, ["cls"], False)])
def test_line_search_matches_plain(spark, number, slab_rows, eq, exclude):
    cases = _cases(spark, 400, 1, NUMBERS[number]).cache()
    asked = cases if exclude else _cases(spark, 120, 2, NUMBERS[number], 1000).withColumn(
        "f", F.when(F.col("id") % 17 == 0, F.lit("new")).otherwise(F.col("f")))
    metric = Metric.of(SPEC, joint_counts(cases, SPEC), sigma(cases, SPEC))
    left = asked.withColumnRenamed("id", "query_id")
    right = cases.withColumnRenamed("id", "case_id")
    options = dict(left_key=["query_id"], right_key=["case_id"], k=6, eq=eq, n_right=400,
                   exclude_self=("query_id", "case_id") if exclude else None,
                   left_payload={"own": "label"}, right_payload={"found": "label"})
    plain = blocked_topk(left, right, kernel=metric.kernel, attach=metric.attach, **options)
    lines = line_search(left, right, feats=SPEC.order, metric=metric, slab_rows=slab_rows, left_rows=50, least_rows=0, **options)
    names = [*eq, "query_id", "rank", "case_id", "distance", "own", "found"]
    want, got = (df.select(*names).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
                 for df in (plain, lines))
    assert len(want) > 0
    pd.testing.assert_frame_equal(got, want)


def test_blocks_are_spread_over_tasks(spark):
    spec = FeatureSpec("id", "label", (), ("x", "y"))
    cases = spark.createDataFrame([(i, "AB"[i % 2], float(i * i % 97), float(i % 31)) for i in range(400)],
                                  "id long, label string, x double, y double")
    metric = Metric.of(spec, spark.createDataFrame([], "feature string, value string, label string, n long"),
                       sigma(cases, spec))
    options = dict(left_key=["query_id"], right_key=["case_id"], k=3, kernel=metric.kernel, attach=metric.attach,
                   merge=False)
    left, right = cases.withColumnRenamed("id", "query_id"), cases.withColumnRenamed("id", "case_id")
    found = blocked_topk(left, right, left_block_rows=40, right_block_rows=100, **options)
    assert found.rdd.getNumPartitions() >= 40
    key = ["query_id", "distance", "case_id"]
    best = found.toPandas().sort_values(key).groupby("query_id").head(3).reset_index(drop=True)[key]
    whole = blocked_topk(left, right, **options).toPandas().sort_values(key).reset_index(drop=True)[key]
    pd.testing.assert_frame_equal(best, whole)


def test_rows_beyond_the_limit_are_not_looked_at():
    class Tables:
        value = {((), "f"): {f"v{i}": {"A": 1, "B": 1} for i in range(40)}}, {(): 1000.0}
    rng = np.random.default_rng(3)
    cases = pd.DataFrame({"f": [f"v{i % 40}" for i in range(20_000)], "x": rng.uniform(0, 1000, 20_000)})
    asked = cases.sample(200, random_state=4).reset_index(drop=True)
    block = LineKernel(("f", "x"), "x", (), Tables()).block(asked, cases)
    found, cols = block.topk(5)
    whole = np.sqrt(np.abs(asked["x"].to_numpy()[:, None] - cases["x"].to_numpy()[None, :]) / 4000.0)
    want = np.lexsort((np.broadcast_to(np.arange(20_000), whole.shape), whole), axis=1)[:, :5]
    assert (cols == want).all() and (found == np.take_along_axis(whole, want, axis=1)).all()
    assert block.looked < 200 * 500                  # before: a window of 25 rows in each of 40 profiles


def test_only_rows_that_reach_other_slabs_are_searched_again(spark, monkeypatch):
    cases = spark.createDataFrame([(i, "AB"[i % 2], "pq"[i % 3 % 2], "uv"[i % 2], float(i)) for i in range(2000)],
                                  "id long, label string, f string, g string, x double")
    metric = Metric.of(SPEC, joint_counts(cases, SPEC), sigma(cases, SPEC))
    again = []
    plain = line.blocked_topk

    def counted(left, right, **options):
        again.append(left.count())
        return plain(left, right, **options)
    monkeypatch.setattr(line, "blocked_topk", counted)
    options = dict(left_key=["query_id"], right_key=["case_id"], k=3, n_right=2000, least_rows=0, slab_rows=500)
    got = line_search(cases.withColumnRenamed("id", "query_id"), cases.withColumnRenamed("id", "case_id"),
                      feats=SPEC.order, metric=metric, **options)
    assert got.count() == 6000
    assert len(again) == 1 and again[0] < 200        # before: all 2000
