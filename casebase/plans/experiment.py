"""Experiments: repeated hold-out (E9) and the (k, rno, radius) sweep.

Repetitions and folds are key columns, so every repetition or fold runs in the
same jobs as the others.  Their counts come from one reading of the cases, not from copies.  In the sweep, neighbours are searched once at the
largest ``k``, leave-self-out neighbours once at the largest radius, and rules
retrieved once per radius at the largest ``rno``;
every grid point is then a pair of rank filters over a query's chosen rules, which
are brought together once for all points (``vote.grid_right``).
Only the radius changes the rule base (and its metric), so there are
``len(radii)`` rule fits, not one per grid point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators.classify import (adapt_classify, adaptation_votes, knn_classify,
                                   neighbours_with_payload)
from ..operators.naive_bayes import naive_bayes_by_key
from ..operators.neighbors import nearest_within
from ..operators.prepare import fold_sides, holdout_sides
from ..operators.stats import joint_counts_by_fold, joint_counts_by_rep
from ..operators.vote import grid_right
from ..session import cut_lineage
from ..spec import FeatureSpec
from .model import CaseModel

# fixed values: the reference's sweep grid
KS = (1, 2, 3, 5, 10)
RNOS = (1, 2, 3, 5, 10)
RADII = (5, 10, 20)


METHODS = ("knn", "adapt", "nb", "lr", "rf")


def holdout(cases: DataFrame, spec: FeatureSpec, method: str, reps: int = 10, k: int = 5,
            rno: int = 5, radius: int = 3, fraction: float = 0.7) -> DataFrame:
    """Metrics per repetition.

    ``knn``/``adapt``/``nb`` run all repetitions in one job (``rep`` is a key);
    the library learners (``lr``, ``rf``) fit one model per
    repetition and the predictions are unioned before one metrics pass
    (``rf`` tuned on the small grid by a train/validation split).
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: expected one of {METHODS}")
    if method in ("lr", "rf"):
        return _holdout_baseline(cases, spec, method, reps, fraction)
    train, test = holdout_sides(cases, spec.id, reps, fraction)
    if method == "nb":
        pred = naive_bayes_by_key(train, test, spec, ["rep"])
        return E.metrics(pred, ["rep"]).withColumn("method", F.lit(method))
    joint = joint_counts_by_rep(cases, spec, reps, fraction) if spec.categorical else None
    m = CaseModel.fit(train, spec, radius=radius if method == "adapt" else None, by=["rep"], joint=joint)
    pred = knn_classify(test, m, k) if method == "knn" else adapt_classify(test, m, k, rno)
    out = cut_lineage(E.metrics(pred, ["rep"]).withColumn("method", F.lit(method)))      # a row a repetition
    m.release()
    return out


def compare(cases: DataFrame, spec: FeatureSpec, methods: Sequence[str] = METHODS, **options) -> DataFrame:
    """E9 for several methods: their metrics over the same repetitions, in one table."""
    out = None
    for method in methods:
        rows = holdout(cases, spec, method, **options)
        out = rows if out is None else out.unionByName(rows)
    return out


def _holdout_baseline(cases: DataFrame, spec: FeatureSpec, method: str, reps: int,
                      fraction: float) -> DataFrame:
    from ..functions.splits import is_train
    from . import baselines as B
    preds = None
    for rep in range(reps):
        t = is_train(spec.id, rep, fraction)
        train, test = cases.where(t), cases.where(~t)
        if method == "lr":
            p = B.logistic(train, test, spec)
        else:
            p = B.random_forest_tvs(train, test, spec, B.RF_GRID_SMALL)[0]
        p = p.withColumn("rep", F.lit(rep))
        preds = p if preds is None else preds.unionByName(p)
    return E.metrics(preds, ["rep"]).withColumn("method", F.lit(method))


def sweep(cases: DataFrame, spec: FeatureSpec, ks: Sequence[int] = KS,
          rnos: Sequence[int] = RNOS, radii: Sequence[int] = RADII, folds: int = 10,
          seed: int = 0) -> DataFrame:
    """``(radius, k, rno, mean_error)``: mean over folds of the per-fold error."""
    train, test = fold_sides(cases, spec.id, folds, seed)
    joint = joint_counts_by_fold(cases, spec, folds, seed) if spec.categorical else None
    base = CaseModel.fit(train, spec, by=["fold"], joint=joint)
    nb = cut_lineage(neighbours_with_payload(test, base, max(ks)))
    near = cut_lineage(nearest_within(base, max(radii), payload=True))   # one search for all radii
    n_rows, right = test.count() * max(ks) * max(rnos), None
    for radius in radii:
        m = base.with_rules(radius, neighbours=near)
        chosen = adaptation_votes(test, m, max(ks), max(rnos), neighbours=nb, keep_label=True)
        rows = grid_right(chosen, ["fold"], ks, rnos, n_rows).withColumn("radius", F.lit(int(radius)))
        right = rows if right is None else right.unionByName(rows)
    # every test case counts at every point, also where no base has a label or a rule
    points = test.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    for name, values in (("radius", radii), ("k", ks), ("rno", rnos)):
        points = points.withColumn(name, F.explode(F.array(*[F.lit(int(v)) for v in sorted(set(values))])))
    per_fold = points.join(right, ["radius", "k", "rno", "fold"], "left").withColumn(
        "e", (F.col("n") - F.coalesce("right", F.lit(0))) / F.col("n"))
    report = cut_lineage(per_fold.groupBy("radius", "k", "rno").agg(
        F.round(F.avg("e"), 9).alias("mean_error")))                                     # a row a point
    base.release()
    return report


def best(report: DataFrame) -> DataFrame:
    """The grid point with the smallest mean error (ties: smallest k, rno, radius)."""
    return report.orderBy("mean_error", "k", "rno", "radius").limit(1)
