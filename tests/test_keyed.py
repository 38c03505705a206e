"""Indexes, value pairs and naive Bayes without the driver: against the library and plain counting."""

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from casebase import FeatureSpec
from casebase.operators.naive_bayes import naive_bayes_by_key
from casebase.operators.prepare import assemble, fold_sides, holdout_sides, string_index, value_index
from casebase.operators.stats import joint_counts, joint_counts_by_fold, joint_counts_by_rep
from casebase.operators.vdm import vdm
from casebase.plans import baselines as B
from casebase.plans import jobs
from casebase.sources import casebases as CB

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def values(spark):
    rows = [(i, "a" if i % 3 == 0 else f"v{i % 7}", "é" if i % 2 else "z", i % 4) for i in range(300)]
    return spark.createDataFrame([*rows, (900, None, "z", 1), (901, "", None, 2)],
                                 "id long, f string, g string, x int")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_index_like_the_library(spark, values, limit):
    train = values.where("id % 5 > 0 and f is distinct from 'v6'")
    model = StringIndexer(inputCols=["f", "g"], outputCols=["f_idx", "g_idx"], handleInvalid="keep").fit(train)
    want = sorted(model.transform(values).select("id", "f_idx", "g_idx").collect())
    got = string_index(values, ["f", "g"], fit_on=train, broadcast_bytes=limit, hot=2)
    assert got.columns == ["id", "f", "g", "x", "f_idx", "g_idx"]
    assert sorted(got.select("id", "f_idx", "g_idx").collect()) == want


def test_index_by_key_and_empty(spark, values):
    got = string_index(values, ["f"], by=["x"], broadcast_bytes=0, hot=1)
    for x in range(4):
        part = values.where(F.col("x") == x)
        want = sorted(string_index(part, ["f"]).select("id", "f_idx").collect())
        assert sorted(got.where(F.col("x") == x).select("id", "f_idx").collect()) == want
    none = string_index(values, ["f"], fit_on=values.where("false"))
    assert none.count() == 302 and {r.f_idx for r in none.collect()} == {0.0}


def test_unknown_labels_raise(spark, values):
    spec = FeatureSpec("id", "g", ("f",), ("x",))
    known = values.where("g = 'z' and f is not null")
    assert assemble(known, spec).count() == known.count()
    with pytest.raises(Exception, match="not seen in training"):
        assemble(values.where("f is not null"), spec, fit_on=known).collect()


def test_a_million_values_are_ranked_without_one_task(spark):
    many = spark.range(1_000_000).select(F.concat(F.lit("v"), F.format_string("%07d", "id")).alias("f"))
    df = many.union(many.where("f = 'v0500000'"))
    got = value_index(df, ["f"])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    by_value = (F.when(F.col("value") == "v0500000", 0.0)
                .when(F.col("value") < "v0500000", F.substring("value", 2, 7).cast("double") + 1)
                .otherwise(F.substring("value", 2, 7).cast("double")))
    assert got.where((F.col("idx") != by_value) | (F.col("n_values") != 1_000_000)).count() == 0
    assert got.count() == 1_000_000


def test_pairs_that_share_a_class_only(spark):
    """20,000 values of 1,000 classes: 20 values a class, 190 pairs each."""
    joint = spark.range(20_000).select(F.lit("f").alias("feature"), F.col("id").cast("string").alias("value"),
                                       (F.col("id") % 1000).cast("string").alias("label"),
                                       (F.col("id") % 3 + 1).alias("n"))
    got = vdm(joint, dense=False)
    r = got.agg(F.count(F.lit(1)).alias("n"), F.max("vdm").alias("most")).first()
    assert (r.n, r.most) == (190_000, 0.0)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_change_nothing(spark, block):
    joint = spark.range(60).select(
        F.lit("f").alias("feature"), (F.col("id") % 13).cast("string").alias("value"),
        (F.col("id") % 5).cast("string").alias("label"), (F.col("id") % 4 + 1).alias("n")).groupBy(
        "feature", "value", "label").agg(F.sum("n").alias("n"))
    joint = joint.where("not (value in ('3', '7') and label <> value)")
    by: dict = {}
    for r in joint.collect():
        by.setdefault(r.value, {})[r.label] = r.n
    dense = {(r.v1, r.v2): r.vdm for r in vdm(joint, block=block).collect()}
    assert set(dense) == {(a, b) for a in by for b in by if a < b}
    for (a, b), d in dense.items():
        m, n = by[a], by[b]
        assert d == pytest.approx(sum(abs(m.get(c, 0) / sum(m.values()) - n.get(c, 0) / sum(n.values()))
                                      for c in {*m, *n}), abs=1e-12)
    rows = vdm(joint, dense=False, block=block).collect()
    sparse = {(r.v1, r.v2): r.vdm for r in rows}
    assert len(rows) == len(sparse) and sparse == {
        (a, b): d for (a, b), d in dense.items() if set(by[a]) & set(by[b])}
    assert all(d == 2.0 for p, d in dense.items() if p not in sparse)


def test_naive_bayes_of_all_repetitions_like_the_library(spark):
    spec, train, test = jobs.sides(spark, SF, "docs")
    cases = train.unionByName(test)
    tr, te = holdout_sides(cases, spec.id, 3)
    got = naive_bayes_by_key(tr, te, spec, ["rep"])
    for rep in range(3):
        own = F.col("rep") == rep
        want = sorted(map(tuple, B.naive_bayes(tr.where(own), te.where(own), spec).collect()))
        assert sorted(tuple(r)[1:] for r in got.where(own).collect()) == want


def test_naive_bayes_odd_rows(spark):
    spec = FeatureSpec("id", "label", ("f",), ("x",))
    df = spark.createDataFrame([(1, "a", 1.0, "P"), (2, "a", None, "P"), (3, "b", float("nan"), "N"),
                                (4, None, 2.0, "N"), (5, "b", 9.0, None), (6, "c", 0.0, None)],
                               "id long, f string, x double, label string")
    got = naive_bayes_by_key(df, df, spec).collect()
    assert len(got) == 6 and {r.prediction for r in got} <= {"P", "N"}
    assert {r.prediction for r in naive_bayes_by_key(df.where("false"), df, spec).collect()} == {None}
    with pytest.raises(Exception, match="negative"):
        naive_bayes_by_key(df.withColumn("x", F.lit(-1.0)), df, spec).collect()


def test_counts_of_folds_and_repetitions_like_those_of_copies(spark):
    """Also with NULLs, empty folds and a case base without rows."""
    spec = FeatureSpec("id", "label", ("f", "g"))
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"v{i % 4}", f"w{i % 3}", None if i % 7 == 0 else f"c{i % 2}")
                                for i in range(60)] + [(None, "only", None, "c0")],
                               "id long, f string, g string, label string")
    for cases in (df, df.limit(2), df.where("false")):
        for key, got, train in (("fold", joint_counts_by_fold(cases, spec, 5, 3), fold_sides(cases, "id", 5, 3)[0]),
                                ("rep", joint_counts_by_rep(cases, spec, 4, 0.5), holdout_sides(cases, "id", 4, 0.5)[0])):
            want = joint_counts(train, spec, [key])
            assert got.columns == want.columns and got.dtypes == want.dtypes
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_counts_of_folds_read_each_case_once(spark):
    spec, cases = CB.docs(spark, SF)
    plan = joint_counts_by_fold(cases, spec, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 1 and plan.index("explode") < plan.index("Expand")
