"""Data preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import splits
from ..session import cut_lineage
from ..spec import FeatureSpec
from .metric import BROADCAST_BYTES


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None, marker: str = "?") -> DataFrame:
    """Drop rows where any of ``cols`` is null or equals the missing marker."""
    cols = list(cols or df.columns)
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & (F.col(c).cast("string") != F.lit(marker))
    return df.where(cond)


def value_index(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by.., feature, value, idx, n_values)``: every value's place by descending
    frequency (ties alphabetical), from 0, within its feature and keys.  NULL is not a value.

    No task or window holds a whole feature: the counts are range-partitioned in their
    order, ranked within a partition, and the sizes of the partitions before are added.
    """
    by = list(by)
    keys = [*by, "feature"]
    counts = (df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols])
              .unpivot(ids=by, values=list(cols), variableColumnName="feature", valueColumnName="value")
              .where(F.col("value").isNotNull())
              .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")))
    ranged = cut_lineage(counts.repartitionByRange(*keys, F.desc("n"), "value")
                         .withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (ranged.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("m"))     # a row a partition
             .select(*keys, "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"),
                     F.sum("m").over(Window.partitionBy(*keys)).alias("n_values")))
    inside = Window.partitionBy(*keys, "part").orderBy(F.desc("n"), "value")
    return (ranged.withColumn("i", F.row_number().over(inside)).join(sizes, [*keys, "part"])
            .select(*keys, "value", (F.col("before") + F.col("i") - 1).cast("double").alias("idx"),
                    "n_values"))


def string_index(df: DataFrame, cols: Sequence[str], suffix: str = "_idx",
                 fit_on: DataFrame | None = None, by: Sequence[str] = (), unseen: str = "keep",
                 broadcast_bytes: int = BROADCAST_BYTES, hot: int = 1000) -> DataFrame:
    """Index string columns by descending frequency (ties alphabetical).

    ``fit_on`` lets the index learn frequencies from the training rows only, ``by`` keeps
    one index a repetition or fold.  Unseen and NULL values get the number of
    values as their index, or raise with ``unseen="error"``.

    An index of at most ``broadcast_bytes`` (measured) is broadcast.  Of a larger one only
    the ``hot`` most frequent values are; rows with others meet the rest by a shuffle in which no
    value is frequent, and rows already indexed are spread by their partition.
    """
    if unseen not in ("keep", "error"):
        raise ValueError(f"unseen {unseen!r}: expected keep or error")
    by, cols = list(by), list(cols)
    index = cut_lineage(value_index(df if fit_on is None else fit_on, cols, by))
    size = index.agg(F.sum(F.octet_length("value") + 64).alias("n")).first().n
    small = (size or 0) <= broadcast_bytes
    totals = (index.groupBy(*by, "feature").agg(F.max("n_values").alias("n"))        # a row a feature and key
              .groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("n"))).alias("_n_" + c)
                                  for c in cols]))
    known = None if by else totals.first()
    out = df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])
    names = list(out.columns)
    if by:
        out = out.join(F.broadcast(totals), by, "left")
    for c in cols:
        one = index.where(F.col("feature") == c).select(*by, F.col("value").alias(c), "idx")
        if small:
            out = out.join(F.broadcast(one.withColumnRenamed("idx", "_found")), [*by, c], "left")
        else:
            often = one.where(F.col("idx") < hot).withColumnRenamed("idx", "_often")
            rare = one.where(F.col("idx") >= hot).select(
                *by, F.col(c).alias("_rest"), F.lit(0).alias("_salt"), F.col("idx").alias("_rare"))
            out = out.join(F.broadcast(often), [*by, c], "left")
            out = out.withColumn("_rest", F.when(F.col("_often").isNull(), F.col(c)))
            out = out.withColumn("_salt", F.when(F.col("_rest").isNull(), F.spark_partition_id() + 1)
                                 .otherwise(F.lit(0)))
            out = (out.join(rare, [*by, "_rest", "_salt"], "left")
                   .withColumn("_found", F.coalesce("_often", "_rare"))
                   .drop("_rest", "_salt", "_often", "_rare"))
        n = F.col("_n_" + c) if by else F.lit(known["_n_" + c])
        other = F.coalesce(n.cast("double"), F.lit(0.0)) if unseen == "keep" else F.raise_error(
            F.concat(F.lit(f"value of {c} not seen in training: "),
                     F.coalesce(F.col(c), F.lit("NULL")))).cast("double")
        kinds = 0 if by else int(known["_n_" + c] or 0)
        values = {"num_vals": kinds + (unseen == "keep")}
        if unseen == "error" and 0 < kinds <= hot:       # few classes: their names
            values = {"vals": [r.value for r in index.where(F.col("feature") == c).orderBy("idx").collect()]}
        meta = {} if by else {"ml_attr": {"type": "nominal", "name": c + suffix} | values}
        names.append(c + suffix)
        out = out.withColumn(c + suffix, F.coalesce("_found", other).alias(c + suffix, metadata=meta)).drop("_found")
    return out.select(*names)


def assemble(df: DataFrame, spec: FeatureSpec, label_col: str = "label_idx",
             fit_on: DataFrame | None = None) -> DataFrame:
    """``(id, label_idx, features)`` with categorical features indexed.

    The vector holds the features in spec order: indexed categorical values
    and raw numeric values.
    """
    cat = list(spec.categorical)
    # exactly the classes that occur: no index for an unknown label
    learn = (df if fit_on is None else fit_on).withColumn("_label", F.col(spec.label).cast("string"))
    indexed = string_index(df, cat, fit_on=fit_on) if cat else df
    indexed = string_index(indexed.withColumn("_label", F.col(spec.label).cast("string")), ["_label"],
                           fit_on=learn, unseen="error").withColumnRenamed("_label_idx", label_col)
    inputs = [f + "_idx" if spec.kind(f) == "cat" else f for f in spec.order]
    va = VectorAssembler(inputCols=inputs, outputCol="features")
    return va.transform(indexed).select(spec.id, spec.label, label_col, "features")


def split(df: DataFrame, key: str, fraction: float = 0.7, rep: int = 0):
    """Deterministic ``(train, test)`` split on the key."""
    t = splits.is_train(key, rep, fraction)
    return df.where(t), df.where(~t)


def with_fold(df: DataFrame, key: str, k: int, seed: int = 0, col: str = "fold") -> DataFrame:
    """Fold number ``0..k-1`` as a column (folds are a key, not k DataFrames)."""
    return df.withColumn(col, splits.fold(key, k, seed))


def replicate(df: DataFrame, n: int, col: str = "rep") -> DataFrame:
    """Copy every row ``n`` times with ``col`` = 0..n-1 (a generator, not a join)."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def holdout_sides(cases: DataFrame, key: str, reps: int, fraction: float = 0.7):
    """E9 input: ``(train, test)`` with a ``rep`` key; each rep is its own split."""
    rep = replicate(cases, reps)
    t = splits.is_train(key, "rep", fraction)
    return rep.where(t), rep.where(~t)


def fold_sides(cases: DataFrame, key: str, k: int, seed: int = 0):
    """K-fold ``(train, test)`` with a ``fold`` key: fold f tests on the rows of fold f."""
    rep = replicate(cases, k, "fold")
    own = splits.fold(key, k, seed)
    return rep.where(own != F.col("fold")), rep.where(own == F.col("fold"))
