"""Counting statistics of a case base (A1-A4).

Every categorical feature is unpivoted once into ``(feature, value, label)``
rows and counted in a single aggregation, which Spark runs as a map-side
partial aggregate followed by one shuffle of the (small) partial counts.  A
value or label that holds a third of all rows therefore costs nothing extra:
each map task emits one partial row per distinct key.

All operators take ``by``: extra key columns (repetition, fold, ...) that are
carried through every group, so many experiments run as one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import splits
from ..spec import FeatureSpec


def class_counts(cases: DataFrame, spec: FeatureSpec, by: Sequence[str] = ()) -> DataFrame:
    """A1: ``(by.., label, n)``."""
    return cases.groupBy(*by, spec.label).agg(F.count(F.lit(1)).alias("n"))


def unpivot_categorical(cases: DataFrame, spec: FeatureSpec, by: Sequence[str] = (),
                        label: str | None = None) -> DataFrame:
    """``(by.., label, feature, value)``: one row per case and categorical feature."""
    label = label or spec.label
    if not spec.categorical:
        raise ValueError("spec has no categorical features")
    return cases.unpivot(
        ids=[*by, label], values=list(spec.categorical),
        variableColumnName="feature", valueColumnName="value")


def joint_counts(cases: DataFrame, spec: FeatureSpec, by: Sequence[str] = (),
                 label: str | None = None) -> DataFrame:
    """A3: ``(by.., feature, value, label, n)`` for every categorical feature."""
    label = label or spec.label
    long = unpivot_categorical(cases, spec, by, label)
    return (long.groupBy(*by, "feature", "value", label)
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumnRenamed(label, "label"))


def value_counts(joint: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2 as a roll-up of A3: ``(by.., feature, value, n)``."""
    return joint.groupBy(*by, "feature", "value").agg(F.sum("n").alias("n"))


def joint_counts_by_fold(cases: DataFrame, spec: FeatureSpec, k: int, seed: int = 0) -> DataFrame:
    """A3 of the training side of every fold: ``(fold, feature, value, label, n)``.

    Every case is counted once, in its own fold; a fold's training counts are the totals without it.
    """
    own = joint_counts(cases.withColumn("fold", splits.fold(spec.id, k, seed)), spec, ["fold"])
    per = own.groupBy("feature", "value", "label").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"))
    return (per.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("n", F.col("total") - F.coalesce(F.try_element_at("own", F.col("fold")), F.lit(0)))
            .where(F.col("n") > 0).select("fold", "feature", "value", "label", "n"))


def joint_counts_by_rep(cases: DataFrame, spec: FeatureSpec, reps: int, fraction: float = 0.7) -> DataFrame:
    """A3 of the training side of every hold-out repetition: ``(rep, feature, value, label, n)``.

    Every case is read once and counted in all repetitions that train on it: a sum a repetition.
    """
    sides = [f"_t{r}" for r in range(reps)]
    marked = cases.select(spec.label, *spec.categorical,
                          *[splits.is_train(spec.id, r, fraction).cast("long").alias(t) for r, t in enumerate(sides)])
    per = (unpivot_categorical(marked, spec, sides).withColumnRenamed(spec.label, "label")
           .groupBy("feature", "value", "label").agg(F.array(*[F.sum(t) for t in sides]).alias("each")))
    return (per.select("feature", "value", "label", F.posexplode("each").alias("rep", "n"))
            .where(F.col("n") > 0).select("rep", "feature", "value", "label", "n"))


def sigma(cases: DataFrame, spec: FeatureSpec, by: Sequence[str] = ()) -> DataFrame:
    """A4: ``(by.., feature, sigma)``, sample standard deviation to 10 significant digits.

    Rounding makes the value independent of the order in which partial
    variances are merged; significant digits keep small units as exact as large ones.  Constants in ``spec.sigma`` override the estimate.
    Missing numbers (NULL, NaN) are left out; with fewer than two others the spread is NULL.
    """
    if not spec.numeric:
        schema = ", ".join([f"`{b}` string" for b in by] + ["feature string", "sigma double"])
        return cases.sparkSession.createDataFrame([], schema)
    wide = cases.groupBy(*by).agg(*[F.stddev_samp(F.when(~F.isnan(f), F.col(f))).alias(f) for f in spec.numeric])
    # the text of a NULL is not NULL
    wide = wide.select(*by, *[F.when(F.col(f).isNotNull(), F.format_string("%.9e", F.col(f)))
                              .cast("double").alias(f) for f in spec.numeric])
    long = wide.unpivot(ids=list(by), values=list(spec.numeric),
                        variableColumnName="feature", valueColumnName="sigma")
    if spec.sigma:
        fixed = F.create_map(*[x for f, s in spec.sigma.items()
                               for x in (F.lit(f), F.lit(float(s)))])
        long = long.withColumn("sigma", F.coalesce(fixed[F.col("feature")], F.col("sigma")))
    return long
