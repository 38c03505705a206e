"""The learned metric as columns of the rows.

``class_vectors`` packs each seen value's class counts (A3) into one row;
``Metric.attach`` joins them to cases, queries, rules or profiles on the value, and the
spreads on the experiment keys.  The tables stay DataFrames (of a single experiment only
its one row of spreads reaches the driver), and are broadcast only if their measured size is below ``BROADCAST_BYTES``; larger ones
are joined by a shuffle, where adaptive execution splits a hot value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Kernel
from ..session import cut_lineage
from ..spec import FeatureSpec

BROADCAST_BYTES = 16 << 20


def class_vectors(joint: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., feature, value, counts)``: the class counts of every seen value as a JSON
    object label -> count.  NULL is not a value; a NULL label is not a class."""
    entry = F.struct(F.col("label").cast("string").alias("label"), F.col("n"))
    return (joint.where(F.col("value").isNotNull() & F.col("label").isNotNull())
            .groupBy(*by, "feature", "value")
            .agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("counts")))


@dataclass
class Metric:
    """Class vectors and spreads of one fitted case base (or rule base)."""

    spec: FeatureSpec
    by: tuple
    vectors: DataFrame
    sigma: DataFrame
    small: bool
    line: object = None          # the kernel of the search on number lines, once made (operators.line)

    @classmethod
    def of(cls, spec: FeatureSpec, joint: DataFrame, sigma: DataFrame,
           by: Sequence[str] = ()) -> Metric:
        vectors = cut_lineage(class_vectors(joint, by))
        size = vectors.agg(F.sum(F.length("value") + F.length("counts") + 100).alias("n")).first().n
        return cls(spec, tuple(by), vectors, sigma, (size or 0) <= BROADCAST_BYTES)

    @property
    def kernel(self) -> Kernel:
        return Kernel(self.spec.order, {f: self.spec.kind(f) for f in self.spec.order})

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_v_<feature>`` and ``_s_<feature>`` columns."""
        by = list(self.by)
        for f in self.spec.categorical:
            one = self.vectors.where(F.col("feature") == f).select(
                *by, F.col("value").alias(f), F.col("counts").alias("_v_" + f))
            rows = rows.join(F.broadcast(one) if self.small else one, [*by, f], "left")
        if self.spec.numeric:
            wide = self.sigma.groupBy(*by).agg(*[
                F.max(F.when(F.col("feature") == f, F.col("sigma"))).alias("_s_" + f)
                for f in self.spec.numeric])
            if by:                                   # one row a repetition or fold
                return rows.join(F.broadcast(wide), by, "left")
            one = wide.first()                       # one number a numeric feature
            return rows.withColumns({c: F.lit(one[c]).cast("double") for c in wide.columns})
        return rows
