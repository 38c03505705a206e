"""Physical-plan checks: pruning, group limits, no cartesian products, no joins back."""

from pyspark.sql import functions as F

from casebase import CaseModel
from casebase.operators.classify import adapt_classify, knn_classify
from casebase.operators.topk import blocked_topk
from casebase.plans import jobs

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_plan(spark):
    spec, train, test = jobs.sides(spark, SF, "docs")
    m = CaseModel.fit(train, spec)
    p = plan(knn_classify(test, m, 5))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "FlatMapCoGroupsInPandas" in p
    # the metric's tables are small and broadcast; labels travel with the search, and the one
    # shuffled join left gives every query its vote
    scans = plan(test).count("SortMergeJoin") * 2 + plan(m.cases).count("SortMergeJoin")
    assert p.count("SortMergeJoin") <= scans + 1


def test_multi_block_merge_uses_group_limit(spark):
    spec, train, test = jobs.sides(spark, SF, "docs")
    m = CaseModel.fit(train, spec)
    left = test.select(F.col(spec.id).alias("query_id"), *spec.order)
    right = m.cases.select(F.col(spec.id).alias("case_id"), *spec.order)
    res = blocked_topk(left, right, left_key=["query_id"], right_key=["case_id"], k=5,
                       kernel=m.metric.kernel, attach=m.metric.attach, right_block_rows=16)
    assert "WindowGroupLimit" in plan(res)


def test_adapt_plan_has_no_cartesian(spark):
    spec, train, test = jobs.sides(spark, SF, "docs")
    m = CaseModel.fit(train, spec, radius=3)
    p = plan(adapt_classify(test, m, 5, 5))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_text_column(spark):
    spec, train, test = jobs.sides(spark, SF, "docs")
    p = plan(train)
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in p


def test_profile_search_limits_hot_profiles_before_shuffle(spark):
    """The per-profile id limit is a WindowGroupLimit, which Spark also runs
    partially in the map stage: a profile holding a third of the rows is cut
    to k rows per task before it is shuffled."""
    from casebase.operators.neighbors import nearest
    spec, train, test = jobs.sides(spark, SF, "ord")
    m = CaseModel.fit(train, spec)
    assert m.use_profiles
    p = plan(nearest(test, m, 5))
    assert "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
