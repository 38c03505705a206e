"""Value difference metric (V1-V3).

For values v1 != v2 of one categorical feature, both seen in training::

    vdm(v1, v2) = sum_c | n(v1,c)/N(v1) - n(v2,c)/N(v2) |

computed bit-exactly as one division of two integers::

    sum_c |n1c*N2 - n2c*N1| / (N1*N2)
      = (2*N1*N2 - 2*sum_{c common} min(n1c*N2, n2c*N1)) / (N1*N2)

The second form needs only the classes that the two values share: classes of one
side only contribute through ``2*N1*N2``.  Products are exact ``decimal(38,0)`` so no
count can overflow.  Pairs of seen values without a common class have vdm 2.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import value_counts

_DEC = "decimal(38,0)"
BLOCK = 1000                              # values of a key that one task pairs with as many


def _with_totals(joint: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = value_counts(joint, by).withColumnRenamed("n", "total")
    return joint.join(totals, on=[*by, "feature", "value"])


def _ratio(num, den):
    return num.cast("double") / den.cast("double")


def _value_pairs(rows: DataFrame, keys: Sequence[str], carried: Sequence[str],
                 block: int) -> DataFrame:
    """``(keys.., v1, v2, <c>1, <c>2)`` with ``v1 < v2``: all pairs of ``value`` with equal ``keys``.

    The values of a key are dealt over parts of about ``block``; a triangle of pairs of
    parts computes every pair of values once, and no task holds more than two parts of a key at a time.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_p"))
    dealt = rows.join(sizes, list(keys)).withColumn(
        "_i", F.pmod(F.xxhash64("value"), F.col("_p")).cast("int"))
    a = dealt.select(*keys, *[F.col(c).alias(c + "_a") for c in ("value", *carried)], "_i",
                     F.explode(F.sequence("_i", F.col("_p") - 1)).alias("_j"))
    b = dealt.select(*keys, *[F.col(c).alias(c + "_b") for c in ("value", *carried)],
                     F.explode(F.sequence(F.lit(0), F.col("_i"))).alias("_k"), F.col("_i").alias("_j")
                     ).withColumnRenamed("_k", "_i")
    ordered = F.col("value_a") < F.col("value_b")
    pairs = a.join(b, [*keys, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | ordered)

    def pick(c: str, first: str, second: str):
        return F.when(ordered, F.col(c + first)).otherwise(F.col(c + second))
    return pairs.select(*keys, pick("value", "_a", "_b").alias("v1"), pick("value", "_b", "_a").alias("v2"),
                        *[pick(c, "_a", "_b").alias(c + "1") for c in carried],
                        *[pick(c, "_b", "_a").alias(c + "2") for c in carried])


def vdm(joint: DataFrame, by: Sequence[str] = (), dense: bool = True, block: int = BLOCK) -> DataFrame:
    """``(by.., feature, v1, v2, vdm)`` with ``v1 < v2``.

    ``dense=True`` lists every pair of seen values (the full metric, an output of
    the square of the number of values).  ``dense=False`` lists only pairs that share a class
    (all others are 2.0): they come from the posting lists of the classes, so values
    without a common class never meet.
    """
    seen = joint.where(F.col("value").isNotNull() & F.col("label").isNotNull())
    keys = [*by, "feature"]
    common = lambda n1, n2: F.least(n1.cast(_DEC) * F.col("t2").cast(_DEC),
                                    n2.cast(_DEC) * F.col("t1").cast(_DEC)).cast(_DEC)
    if dense:
        counts = F.map_from_entries(F.collect_list(F.struct("label", "n")))
        jt = seen.groupBy(*keys, "value").agg(counts.alias("m"), F.sum("n").alias("t"))
        shared = F.aggregate(
            F.array_intersect(F.map_keys("m1"), F.map_keys("m2")), F.lit(0).cast(_DEC),
            lambda s, c: (s + common(F.col("m1")[c], F.col("m2")[c])).cast(_DEC))
        pairs = _value_pairs(jt, keys, ["m", "t"], block).withColumn("shared", shared)
    else:
        totals = seen.groupBy(*keys, "value").agg(F.sum("n").alias("t"))
        listed = seen.select(*keys, "label", "value", "n").join(totals, [*keys, "value"])
        pairs = (_value_pairs(listed, [*keys, "label"], ["n", "t"], block)
                 .groupBy(*keys, "v1", "v2", "t1", "t2")
                 .agg(F.sum(common(F.col("n1"), F.col("n2"))).cast(_DEC).alias("shared")))
    prod = F.col("t1").cast(_DEC) * F.col("t2").cast(_DEC)
    return pairs.select(*keys, "v1", "v2",
                        _ratio(F.lit(2).cast(_DEC) * prod - F.lit(2).cast(_DEC) * F.col("shared"), prod)
                        .alias("vdm"))


def value_profile(joint: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V3: ``(by.., feature, value, label, n, total, p)`` with ``p = n/total``."""
    jt = _with_totals(joint, by)
    return jt.select(*by, "feature", "value", "label", "n", "total",
                     _ratio(F.col("n"), F.col("total")).alias("p"))
