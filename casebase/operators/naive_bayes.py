"""Multinomial naive Bayes as DataFrames, with repetitions or folds as keys.

Features are the training index of a categorical value (by descending frequency, unseen
values last) and the raw numbers, as for the library's learner.  A model is one row a
key: its classes by descending frequency (ties alphabetical) with their log-probabilities.
All keys are counted and scored in the same jobs.

Defined cases: rows without a label are not learned from; a missing number (NULL, NaN) adds
nothing; negative numbers raise, as a count can't be negative; equal scores go to the more
frequent class; a key without training rows predicts NULL; no query is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..spec import FeatureSpec
from .metric import BROADCAST_BYTES
from .prepare import string_index


def _counts(spec: FeatureSpec) -> list[Column]:
    """The features of a row as counts, in spec order."""
    def number(f: str) -> Column:
        x = F.col(f).cast("double")
        return F.when(x < 0, F.raise_error(F.lit(f"naive Bayes: {f} is negative")).cast("double")) \
            .when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)
    return [F.col(f + "_idx") if spec.kind(f) == "cat" else number(f) for f in spec.order]


def fit_naive_bayes(rows: DataFrame, spec: FeatureSpec, by: Sequence[str] = (),
                    smoothing: float = 1.0) -> DataFrame:
    """``(by.., classes)`` from indexed training rows: each class with its label, its
    log-probability ``prior`` and one log-probability a feature."""
    x = _counts(spec)
    sums = (rows.where(F.col(spec.label).isNotNull()).groupBy(*by, F.col(spec.label).alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("s")))
    classes = sums.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("label").cast("string").alias("y"),
                                             "label", "n", "s"))).alias("c"),
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    lam = F.lit(float(smoothing))

    def probabilities(c: Column) -> Column:
        total = F.aggregate(c["s"], F.lit(0.0), lambda a, v: a + v)
        return F.struct(c["label"].alias("label"),
                        (F.log(c["n"] + lam) - F.log(F.col("rows") + F.col("k") * lam)).alias("prior"),
                        F.transform(c["s"], lambda v: F.log(v + lam) - F.log(total + len(x) * lam)).alias("each"))
    return classes.select(*by, F.transform("c", probabilities).alias("classes"))


def naive_bayes_by_key(train: DataFrame, test: DataFrame, spec: FeatureSpec, by: Sequence[str] = (),
                       smoothing: float = 1.0) -> DataFrame:
    """``(by.., query_id, label, prediction)`` of every test row, by the model of its key."""
    by, cat = list(by), list(spec.categorical)
    train = train.where(F.col(spec.label).isNotNull())

    def indexed(rows: DataFrame) -> DataFrame:
        rows = rows.select(*by, spec.id, spec.label, *spec.order)
        return string_index(rows, cat, fit_on=train, by=by) if cat else rows
    # a constant key stands for "no key": the model is joined, never crossed
    model = cut_lineage(fit_naive_bayes(indexed(train), spec, by, smoothing).withColumn("_all", F.lit(0)))
    cells = model.agg(F.sum(F.size("classes")).alias("n")).first().n or 0
    if cells * 8 * (len(spec.order) + 8) <= BROADCAST_BYTES:
        model = F.broadcast(model)
    rows = indexed(test).withColumn("_all", F.lit(0)).join(model, [*by, "_all"], "left")
    x = F.array(*_counts(spec))
    scored = F.transform("classes", lambda c, i: F.struct(
        (c["prior"] + F.aggregate(F.zip_with(c["each"], x, lambda p, v: p * v), F.lit(0.0),
                                  lambda a, v: a + v)).alias("score"),
        (-i).alias("o"), c["label"].alias("label")))
    return rows.select(*by, F.col(spec.id).alias("query_id"), F.col(spec.label).alias("label"),
                       F.array_max(scored)["label"].alias("prediction"))
