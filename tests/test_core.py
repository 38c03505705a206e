"""Rows are never lost, high cardinalities, skew, splits, results."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebase import CaseModel, FeatureSpec
from casebase.functions.kernels import Kernel, topk_weighted, vdm_terms
from casebase.functions.splits import bucket, fold, is_train
from casebase.operators.classify import adapt_classify, knn_classify
from casebase.operators.neighbors import nearest
from casebase.operators.prepare import assemble
from casebase.operators.topk import key_grid
from casebase.operators.vote import vote, vote_bounded
from casebase.session import checkpoint_dir
from casebase.sources.sinks import read_results, write_results


def test_null_numbers_and_labels_keep_every_query(spark):
    spec = FeatureSpec("id", "label", ("f1",), ("x",))
    train = spark.createDataFrame(
        [(i, "ab"[i % 2], None if i == 3 else float(i), "PN"[i % 2] if i != 4 else None) for i in range(12)],
        "id long, f1 string, x double, label string")
    q = spark.createDataFrame([(100, "a", None, "P"), (101, None, 3.0, None), (102, "z", float("nan"), "N"),
                               (103, None, None, "Q")], "id long, f1 string, x double, label string")
    m = CaseModel.fit(train, spec, radius=2)
    assert nearest(q, m, 3).count() == 12
    for df in (knn_classify(q, m, 3), adapt_classify(q, m, 2, 3)):
        got = {r.query_id: (r.label, r.prediction) for r in df.collect()}
        assert {k: v[0] for k, v in got.items()} == {100: "P", 101: None, 102: "N", 103: "Q"}
    d = {(r.query_id, r.case_id): r.distance for r in nearest(q, m, 12).collect()}
    assert d[100, 3] == d[100, 1] and d[103, 3] == d[103, 0] == math.sqrt(2.0)


def test_nothing_can_vote(spark):
    spec = FeatureSpec("id", "label", ("f1",))
    train = spark.createDataFrame([(i, "a", None) for i in range(4)], "id long, f1 string, label string")
    q = spark.createDataFrame([(9, "a", "P")], "id long, f1 string, label string")
    m = CaseModel.fit(train, spec, radius=2)
    assert [tuple(r) for r in knn_classify(q, m, 3).collect()] == [(9, "P", None)]
    assert [tuple(r) for r in adapt_classify(q, m, 2, 2).collect()] == [(9, "P", None)]
    none = CaseModel.fit(train.where(F.lit(False)), spec)
    assert [tuple(r) for r in knn_classify(q, none, 3).collect()] == [(9, "P", None)]


def test_null_does_not_vote(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "b"), (1, "a"), (2, None)], "k long, v string")
    assert {r.k: r.prediction for r in vote_bounded(df, ["k"], "v").collect()} == {1: "a", 2: None}
    assert {r.k: r.prediction for r in vote(df, ["k"], "v").collect()} == {1: "a"}


def test_terms_like_plain_sums_and_beyond_64_bits():
    rng = np.random.default_rng(0)
    for big in (1, 10**12):
        left, right = ([{c: int(n) * big for c, n in zip("abc", rng.integers(0, 9, 3)) if n} or None
                        for _ in range(7)] for _ in range(2))
        got = vdm_terms(left, right)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if a is None or b is None:
                    assert got[i, j] == 1.0
                    continue
                p, q = sum(a.values()), sum(b.values())
                v = sum(abs(a.get(c, 0) * q - b.get(c, 0) * p) for c in "abc") / (p * q)
                assert got[i, j] == pytest.approx(v * v, abs=1e-15)


def test_thousands_of_values_with_nulls():
    rng = np.random.default_rng(1)
    counts = {f"v{i}": json.dumps({"x": int(a), "y": int(b)}) for i, (a, b) in enumerate(
        rng.integers(1, 50, (5000, 2)))}
    names = np.array([*counts, None, "unseen"], dtype=object)

    def side(n):
        v = names[rng.integers(0, len(names), n)]
        return pd.DataFrame({"f": v, "_v_f": [counts.get(x) for x in v]})
    left, right = side(700), side(6000)
    block = Kernel(("f",), {"f": "cat"}).block(left, right)
    assert "f" in block.table or len(left) * len(right) > 0
    d = block.distances(100, 160)
    for i in range(0, 60, 7):
        for j in range(0, 6000, 531):
            a, b = left.f[100 + i], right.f[j]
            if a is not None and a == b:
                want = 0.0
            elif a in counts and b in counts:
                (p, q), (r, s) = (tuple(json.loads(counts[v]).values()) for v in (a, b))
                want = abs(p / (p + q) - r / (r + s)) * 2
            else:
                want = 1.0
            assert d[i, j] == pytest.approx(want, abs=1e-12)


def test_small_tables_and_whole_tables_agree(monkeypatch):
    from casebase.functions import kernels
    test_thousands_of_values_with_nulls()
    monkeypatch.setattr(kernels, "COLUMN_CELLS", 10)
    test_thousands_of_values_with_nulls()


def test_high_cardinality_fit(spark):
    n = 6000
    spec = FeatureSpec("id", "label", ("f1", "f2"))
    cases = spark.range(n).select(
        "id", F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 5000)).alias("f1"),
        (F.col("id") % 3).cast("string").alias("f2"), (F.col("id") % 4).cast("string").alias("label"))
    m = CaseModel.fit(cases, spec, compress=False)
    assert nearest(cases.where("id < 40"), m, 3).count() == 120


def test_weighted_selection_is_bounded():
    d = np.zeros((3, 5000))
    rows, cols, _ = topk_weighted(d, np.ones(5000), 5)
    assert cols.tolist() == [0, 1, 2, 3, 4] * 3
    rng = np.random.default_rng(2)
    d, w = rng.integers(0, 5, (20, 60)).astype(float), rng.integers(1, 4, 60).astype(float)
    rows, cols, _ = topk_weighted(d, w, 6)
    for i in range(20):
        cases = sorted((d[i, j], j, c) for j in range(60) for c in range(int(w[j])))[:6]
        assert {j for _, j, _ in cases} <= set(cols[rows == i])


def test_grid_looks_at_both_sides(spark):
    left = spark.createDataFrame([("a",)] * 900 + [("b",)] * 30, "c string")
    right = spark.createDataFrame([("a",)] * 3 + [("b",)] * 400, "c string")
    got = {r.c: (r._lbn, r._rbn) for r in key_grid(left, right, ["c"], 100, 50, 1, 403).collect()}
    assert got == {"a": (9, 1), "b": (1, 8)}


def test_splits_of_large_and_regular_keys(spark):
    for start, step in ((10**18, 1), (0, 1000), (-5000, 7)):
        ids = spark.range(start, start + 2000 * step, step)
        rows = ids.select(is_train("id").alias("t"), is_train("id", 1).alias("u"), fold("id", 10).alias("f"),
                          bucket("id").alias("b")).collect()
        assert 0.65 < np.mean([r.t for r in rows]) < 0.75
        assert 0.5 < np.mean([r.t == r.u for r in rows]) < 0.66          # repetitions are independent
        assert max(abs(np.bincount([r.f for r in rows], minlength=10) - 200)) < 70
    null = spark.createDataFrame([(None,)], "id long")
    assert null.where(is_train("id") | ~is_train("id")).count() == 1


def test_sigma_of_a_small_unit(spark):
    from casebase.operators.stats import sigma
    spec = FeatureSpec("id", "label", (), ("x",))
    df = spark.range(100).select("id", F.lit("a").alias("label"), (F.col("id") * 1e-9).alias("x"))
    s = sigma(df, spec).first().sigma
    assert s == pytest.approx(np.std(np.arange(100) * 1e-9, ddof=1), rel=1e-9)


def test_label_index_has_only_training_classes(spark):
    spec = FeatureSpec("id", "label", ("f",), ("x",))
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i), "PN"[i % 2]) for i in range(20)],
                               "id long, f string, x double, label string")
    a = assemble(df, spec)
    assert len(a.schema["label_idx"].metadata["ml_attr"]["vals"]) == 2


def test_results_carry_the_run(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "knn")], "rep int, error_rate double, method string")
    write_results(df, str(tmp_path / "r"), run_id="run7")
    got = read_results(spark, str(tmp_path / "r"), schema="run_id string, started timestamp, ended timestamp, "
                       "rep int, error_rate double, method string").collect()
    assert len(got) == 1 and got[0].run_id == "run7" and got[0].started <= got[0].ended and got[0].method == "knn"


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
