"""Named jobs over the driver tables: every registered query of the repo.

Each job is ``(spark, sf_dir) -> DataFrame`` and reads whole tables.  The
split of a case base into training and query rows is the deterministic
70/30 rule of :mod:`casebase.functions.splits` (both sides are used).
Fitted models are cached per session and input so several jobs share one fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import rules as R
from ..operators.classify import adapt_classify, adaptation_votes, knn_classify
from ..operators.neighbors import kth_distance, nearest, nearest_within
from ..operators.prepare import split
from ..operators.stats import (class_counts, joint_counts, joint_counts_by_fold, joint_counts_by_rep,
                               sigma, value_counts)
from ..operators.vdm import value_profile, vdm
from ..sources import casebases as CB
from .model import CaseModel

# fixed parameters of the registered jobs
K = 10
RADIUS = 10
RNO = 10
REPS = 10
# the value that marks a missing one in drop_missing_docs
MISSING = "fr"

_CACHE: dict = {}


def _key(spark: SparkSession, *parts) -> tuple:
    return (spark.sparkContext.applicationId, *parts)


def release(keep: tuple = ()) -> None:
    """Drop the models and tables kept for other sessions or inputs than ``keep``."""
    for key in [x for x in _CACHE if x[:2] != keep]:
        kept = _CACHE.pop(key)
        if isinstance(kept, CaseModel) and key[:1] == keep[:1]:
            kept.release()


def sides(spark: SparkSession, sf_dir: str, cb: str):
    spec, cases = CB.CASEBASES[cb](spark, sf_dir)
    train, test = split(cases, spec.id)
    return spec, train, test


def model(spark: SparkSession, sf_dir: str, cb: str, radius: int | None = None) -> CaseModel:
    key = _key(spark, sf_dir, cb, radius)
    release(keep=(spark.sparkContext.applicationId, sf_dir))
    if key not in _CACHE:
        spec, train, _ = sides(spark, sf_dir, cb)
        base = _CACHE.get(_key(spark, sf_dir, cb, None))
        if base is not None and radius:
            _CACHE[key] = base.with_rules(radius)
        else:
            _CACHE[key] = CaseModel.fit(train, spec, radius=radius)
    return _CACHE[key]


def queries_of(spark, sf_dir, cb):
    return sides(spark, sf_dir, cb)[2]


# ----------------------------------------------------------------- statistics
def class_counts_docs(spark, sf):
    spec, train, _ = sides(spark, sf, "docs")
    return class_counts(train, spec)


def joint_counts_docs(spark, sf):
    spec, train, _ = sides(spark, sf, "docs")
    return joint_counts(train, spec)


def value_counts_docs(spark, sf):
    spec, train, _ = sides(spark, sf, "docs")
    return value_counts(joint_counts(train, spec))


def joint_counts_folds_docs(spark, sf):
    spec, cases = CB.docs(spark, sf)
    return joint_counts_by_fold(cases, spec, REPS)


def joint_counts_reps_docs(spark, sf):
    spec, cases = CB.docs(spark, sf)
    return joint_counts_by_rep(cases, spec, REPS)


def joint_counts_line(spark, sf):
    spec, cases = CB.line(spark, sf)
    return joint_counts(cases, spec)


def _sigma(cb):
    def job(spark, sf):
        spec, train, _ = sides(spark, sf, cb)
        return sigma(train, spec)
    return job


sigma_docs, sigma_cust, sigma_evt = _sigma("docs"), _sigma("cust"), _sigma("evt")


# -------------------------------------------------------------------- metrics
def _vdm(cb):
    def job(spark, sf):
        return model(spark, sf, cb).vdm()
    return job


vdm_docs, vdm_cust, vdm_evt = _vdm("docs"), _vdm("cust"), _vdm("evt")


def vdm_line(spark, sf):
    spec, cases = CB.line(spark, sf)
    return vdm(joint_counts(cases, spec))


def value_profile_docs(spark, sf):
    return value_profile(model(spark, sf, "docs").joint)


# ------------------------------------------------------------------ neighbours
def _knn_topk(cb):
    def job(spark, sf):
        return nearest(queries_of(spark, sf, cb), model(spark, sf, cb), K)
    return job


knn_topk_docs, knn_topk_cust = _knn_topk("docs"), _knn_topk("cust")
knn_topk_evt, knn_topk_emb = _knn_topk("evt"), _knn_topk("emb")
knn_topk_ord = _knn_topk("ord")


def loo_neighbors_ord(spark, sf):
    return nearest_within(model(spark, sf, "ord"), RADIUS)


def kth_distance_docs(spark, sf):
    nb = nearest(queries_of(spark, sf, "docs"), model(spark, sf, "docs"), K + 1)
    return kth_distance(nb, K)


def loo_neighbors_docs(spark, sf):
    return nearest_within(model(spark, sf, "docs"), RADIUS)


# ----------------------------------------------------------------------- rules
def rules_docs(spark, sf):
    return model(spark, sf, "docs", RADIUS).rules


def rules_union_docs(spark, sf):
    m = model(spark, sf, "docs")
    nb = nearest_within(m, RADIUS)
    return R.rules(nb, m.cases, m.spec, (), bidirectional=True)


def rule_class_counts_docs(spark, sf):
    return R.rule_class_counts(model(spark, sf, "docs", RADIUS).rules)


def rule_pair_counts_docs(spark, sf):
    return R.rule_pair_counts(model(spark, sf, "docs", RADIUS).rule_joint)


def rule_joint_counts_docs(spark, sf):
    m = model(spark, sf, "docs", RADIUS)
    typ = m.cases.schema[m.spec.label].dataType
    a, b = R.decode_pair("label", "from_label", "to_label")
    return m.rule_joint.select("feature", *R.decode_pair("value", "from_value", "to_value"),
                               a.cast(typ).alias("from_label"), b.cast(typ).alias("to_label"),
                               "n")


def rule_vdm_docs(spark, sf):
    return model(spark, sf, "docs", RADIUS).rule_vdm()


def antecedents_docs(spark, sf):
    m = model(spark, sf, "docs", RADIUS)
    q = queries_of(spark, sf, "docs")
    return R.antecedents(q, nearest(q, m, K), m.cases, m.spec)


def _rule_topk(cb):
    def job(spark, sf):
        return adaptation_votes(queries_of(spark, sf, cb), model(spark, sf, cb, RADIUS), K, RNO)
    return job


rule_topk_docs, rule_topk_cust = _rule_topk("docs"), _rule_topk("cust")


# ------------------------------------------------------------- classification
def _knn_predict(cb):
    def job(spark, sf):
        return knn_classify(queries_of(spark, sf, cb), model(spark, sf, cb), K)
    return job


def _adapt_predict(cb):
    def job(spark, sf):
        return adapt_classify(queries_of(spark, sf, cb), model(spark, sf, cb, RADIUS), K, RNO)
    return job


knn_predict_docs, knn_predict_cust = _knn_predict("docs"), _knn_predict("cust")
knn_predict_evt, knn_predict_emb = _knn_predict("evt"), _knn_predict("emb")
adapt_predict_docs, adapt_predict_cust = _adapt_predict("docs"), _adapt_predict("cust")
knn_predict_ord, adapt_predict_ord = _knn_predict("ord"), _adapt_predict("ord")


# ------------------------------------------------------------------ evaluation
def confusion_knn_docs(spark, sf):
    return E.confusion(knn_predict_docs(spark, sf))


def confusion_adapt_docs(spark, sf):
    return E.confusion(adapt_predict_docs(spark, sf))


def error_count_knn_docs(spark, sf):
    return E.error_count(knn_predict_docs(spark, sf))


def error_rate_adapt_docs(spark, sf):
    return E.error_rate(adapt_predict_docs(spark, sf))


def metrics_knn_docs(spark, sf):
    return E.metrics(knn_predict_docs(spark, sf))


def metrics_adapt_docs(spark, sf):
    return E.metrics(adapt_predict_docs(spark, sf))


def metrics_knn_cust(spark, sf):
    return E.metrics(knn_predict_cust(spark, sf))


def metrics_adapt_cust(spark, sf):
    return E.metrics(adapt_predict_cust(spark, sf))


def _holdout(cb, method):
    def job(spark, sf):
        from .experiment import holdout
        spec, cases = CB.CASEBASES[cb](spark, sf)
        return holdout(cases, spec, method, REPS, K, RNO, RADIUS)
    return job


holdout_knn_docs = _holdout("docs", "knn")
holdout_adapt_docs = _holdout("docs", "adapt")
holdout_nb_docs = _holdout("docs", "nb")
holdout_lr_docs = _holdout("docs", "lr")
holdout_rf_docs = _holdout("docs", "rf")


def full_classify_docs(spark, sf) -> DataFrame:
    """Flagship: adaptation classify with metrics, all stages from the tables."""
    return metrics_adapt_docs(spark, sf)


# ----------------------------------------------------------------- preparation
def string_index_docs(spark, sf):
    from ..operators.prepare import string_index
    _, train, _ = sides(spark, sf, "docs")
    return string_index(train, ["lang", "source"]).select("doc_id", "lang_idx", "source_idx")


def assembled_docs(spark, sf):
    from pyspark.ml.functions import vector_to_array
    from ..operators.prepare import assemble
    spec, train, _ = sides(spark, sf, "docs")
    a = assemble(train, spec).withColumn("_v", vector_to_array("features"))
    return a.select("doc_id", "label_idx",
                    *[F.col("_v").getItem(i).alias(f"x_{f}") for i, f in enumerate(spec.order)])


def drop_missing_docs(spark, sf):
    from ..operators.prepare import drop_missing
    spec, cases = CB.docs(spark, sf)
    return drop_missing(cases, spec.order, MISSING)


def split_counts_docs(spark, sf):
    from ..functions.splits import is_train
    from ..operators.prepare import replicate
    spec, cases = CB.docs(spark, sf)
    r = replicate(cases, REPS)
    side = F.when(is_train(spec.id, "rep"), F.lit("train")).otherwise(F.lit("test"))
    return r.groupBy("rep", side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def kfold_counts_docs(spark, sf):
    from ..operators.prepare import with_fold
    spec, cases = CB.docs(spark, sf)
    return with_fold(cases, spec.id, 10).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------- sinks and round trips
def _out_path(spark, name: str) -> str:
    import uuid
    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/casebase-out/{name}-{uuid.uuid4().hex}"


def csv_roundtrip_docs(spark, sf):
    """Write the docs case base as headerless CSV, scan it back by layout."""
    from ..sources.delimited import DataSet, read_delimited
    spec, cases = CB.docs(spark, sf)
    path = _out_path(spark, "docs-csv")
    cases.write.option("header", "false").csv(path)
    layout = DataSet(("doc_id", "label", "lang", "source", "n_chars"), "label",
                     ("doc_id", "n_chars"))
    return read_delimited(spark, path, layout, id_col=None)


def libsvm_roundtrip_docs(spark, sf):
    """Assembled training cases written as libsvm lines and read back."""
    from ..operators.prepare import assemble
    from ..sources.sinks import read_libsvm, write_libsvm
    spec, train, _ = sides(spark, sf, "docs")
    path = _out_path(spark, "docs-libsvm")
    write_libsvm(assemble(train, spec), path)
    back = read_libsvm(spark, path, len(spec.order))
    return back.select(F.col("label").alias("label_idx"),
                       *[F.col("features").getItem(i).alias(f"x_{f}")
                         for i, f in enumerate(spec.order)])


def model_roundtrip_docs(spark, sf):
    """Save the fitted model (with rules), load it, classify."""
    m = model(spark, sf, "docs", RADIUS)
    path = _out_path(spark, "docs-model")
    m.save(path)
    loaded = CaseModel.load(spark, path)
    return adapt_classify(queries_of(spark, sf, "docs"), loaded, K, RNO)


def neighbours_sink_docs(spark, sf):
    """O2: neighbour lists written as parquet (bucketed by query) and read back."""
    from ..sources.sinks import write_neighbours
    path = _out_path(spark, "docs-neighbours")
    write_neighbours(knn_topk_docs(spark, sf), path)
    return spark.read.parquet(path).select("query_id", "rank", "case_id", "distance")


def results_sink_docs(spark, sf):
    """O1: hold-out metrics written as a tab-separated result file and read back."""
    from ..sources.sinks import read_results, write_results
    df = holdout_knn_docs(spark, sf)
    path = _out_path(spark, "docs-results")
    write_results(df, path, run_id="docs")
    schema = "run_id string, started timestamp, ended timestamp, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return read_results(spark, path, schema=schema).drop("run_id", "started", "ended")


# -------------------------------------------------------------------- baselines
def _baseline_sides(spark, sf):
    return sides(spark, sf, "docs")


def nb_predict_docs(spark, sf):
    from .baselines import naive_bayes
    spec, train, test = _baseline_sides(spark, sf)
    return naive_bayes(train, test, spec)


def lr_predict_docs(spark, sf):
    from .baselines import logistic
    spec, train, test = _baseline_sides(spark, sf)
    return logistic(train, test, spec)


def _rf(spark, sf, small: bool):
    from .baselines import RF_GRID, RF_GRID_SMALL, random_forest_cv
    key = _key(spark, sf, "rf", small)
    if key not in _CACHE:
        spec, train, test = _baseline_sides(spark, sf)
        _CACHE[key] = random_forest_cv(train, test, spec, RF_GRID_SMALL if small else RF_GRID)
    return _CACHE[key]


def rf_cv_docs(spark, sf):
    return _rf(spark, sf, False)[0]


def rf_cv_report_docs(spark, sf):
    return _rf(spark, sf, False)[1]


def rf_tune_small_docs(spark, sf):
    return _rf(spark, sf, True)[0]


def _tvs(spark, sf):
    from .baselines import random_forest_tvs
    key = _key(spark, sf, "tvs")
    if key not in _CACHE:
        spec, train, test = _baseline_sides(spark, sf)
        _CACHE[key] = random_forest_tvs(train, test, spec)
    return _CACHE[key]


def tvs_predict_docs(spark, sf):
    return _tvs(spark, sf)[0]


def tvs_cases_docs(spark, sf):
    """The queries that the tuned forest has a prediction for: all, once."""
    return tvs_predict_docs(spark, sf).where("prediction IS NOT NULL").select("query_id", "label")


def tvs_grid_docs(spark, sf):
    """The grid points of the report that have a metric: all, once."""
    report = _tvs(spark, sf)[1]
    return report.where("avg_metric BETWEEN 0 AND 1").select(
        "num_trees", "max_depth", "max_bins", "impurity")


def lr_cases_docs(spark, sf):
    """The queries that the logistic model has a prediction for: all, once."""
    return lr_predict_docs(spark, sf).where("prediction IS NOT NULL").select("query_id", "label")


def holdout_lr_counts_docs(spark, sf):
    return holdout_lr_docs(spark, sf).select("rep", "n_test", "method")


def metrics_nb_docs(spark, sf):
    return E.metrics(nb_predict_docs(spark, sf))


def metrics_rf_docs(spark, sf):
    return E.metrics(rf_cv_docs(spark, sf))


# ------------------------------------------------------------------------ sweep
def sweep_docs(spark, sf):
    from ..session import cut_lineage
    from .experiment import sweep
    key = _key(spark, sf, "sweep")
    if key not in _CACHE:
        spec, cases = CB.docs(spark, sf)
        _CACHE[key] = cut_lineage(sweep(cases, spec))
    return _CACHE[key]


def sweep_best_docs(spark, sf):
    """The best (radius, k, rno) of the sweep (a top-1 report)."""
    from .experiment import best
    return best(sweep_docs(spark, sf))
