"""Adaptation rules.

A rule is built from a training case ``src`` and one of its leave-self-out
neighbours ``dst``: "when the features change from src's to dst's values, the
label changes from src's label to dst's label".  A rule's *class* is the
label pair, its categorical *values* are change pairs ``(from, to)`` encoded
as one string ``from SEP to`` (binary order of the encoding equals the order
of the pair), and its numeric values are differences ``from - to``.  The rule
metric is the ordinary VDM applied to that encoding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import FeatureSpec
from .stats import class_counts, joint_counts, value_counts
from .compressed import profile_topk
from .bounded import search_for
from .line import line_search
from .vdm import vdm

SEP = "\u0001"


def _pair(a, b):
    return F.concat(a.cast("string"), F.lit(SEP), b.cast("string"))


def rules(neighbours: DataFrame, cases: DataFrame, spec: FeatureSpec, by: Sequence[str] = (),
          bidirectional: bool = False) -> DataFrame:
    """R1 (and R2/R3 with ``bidirectional``), keyed by ``(src_id, dst_id, direction)``.

    ``neighbours`` is the leave-self-out ranking of the training cases (K2).
    Columns: ``by.., src_id, dst_id, direction, rank, from_label, to_label,
    <f>_from, <f>_to`` for every feature.
    """
    by = list(by)
    if "from_label" in neighbours.columns:        # search already carried both cases
        return _rules_from_payload(neighbours, spec, by, bidirectional)

    def side(prefix: str, key: str, lab: str) -> DataFrame:
        return cases.select(*by, F.col(spec.id).alias(key), F.col(spec.label).alias(lab),
                            *[F.col(f).alias(f"{f}_{prefix}") for f in spec.order])

    pairs = neighbours.select(*by, F.col("query_id").alias("src_id"),
                              F.col("case_id").alias("dst_id"), "rank")
    if bidirectional:
        rev = pairs.select(*by, F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"),
                           "rank")
        pairs = (pairs.withColumn("direction", F.lit(0))
                 .unionByName(rev.withColumn("direction", F.lit(1))))
    else:
        pairs = pairs.withColumn("direction", F.lit(0))
    out = (pairs.join(side("from", "src_id", "from_label"), on=[*by, "src_id"])
           .join(side("to", "dst_id", "to_label"), on=[*by, "dst_id"]))
    cols = [*by, "src_id", "dst_id", "direction", "rank", "from_label", "to_label"]
    for f in spec.order:
        cols += [f"{f}_from", f"{f}_to"]
    return out.select(*cols)


def _rules_from_payload(nb: DataFrame, spec: FeatureSpec, by: list,
                        bidirectional: bool) -> DataFrame:
    """R1-R3 as a projection of a leave-self-out search that carried both cases."""
    feats = [c for f in spec.order for c in (f"{f}_from", f"{f}_to")]
    fwd = nb.select(*by, F.col("query_id").alias("src_id"), F.col("case_id").alias("dst_id"),
                    F.lit(0).alias("direction"), "rank", "from_label", "to_label", *feats)
    if not bidirectional:
        return fwd
    swapped = [F.col(f"{f}_{b}").alias(f"{f}_{a}") for f in spec.order
               for a, b in (("from", "to"), ("to", "from"))]
    rev = nb.select(*by, F.col("case_id").alias("src_id"), F.col("query_id").alias("dst_id"),
                    F.lit(1).alias("direction"), "rank", F.col("to_label").alias("from_label"),
                    F.col("from_label").alias("to_label"), *swapped)
    return fwd.unionByName(rev)


RULE_KEY = ["src_id", "dst_id", "direction"]


def rule_cases(rule_df: DataFrame, spec: FeatureSpec, by: Sequence[str] = ()) -> DataFrame:
    """Encode rules as cases: ``rule_class``, change-pair strings, numeric deltas."""
    cols = [*by, *RULE_KEY, "from_label", "to_label",
            _pair(F.col("from_label"), F.col("to_label")).alias("rule_class")]
    for f in spec.order:
        a, b = F.col(f"{f}_from"), F.col(f"{f}_to")
        cols.append((_pair(a, b) if spec.kind(f) == "cat" else (a - b)).alias(f))
    return rule_df.select(*cols)


def rule_spec(spec: FeatureSpec) -> FeatureSpec:
    return FeatureSpec(id="src_id", label="rule_class", categorical=spec.categorical,
                       numeric=spec.numeric, order=spec.order)


def rule_class_counts(rule_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A5: ``(by.., from_label, to_label, n)``."""
    return rule_df.groupBy(*by, "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))


def rule_joint_counts(rcases: DataFrame, spec: FeatureSpec, by: Sequence[str] = ()) -> DataFrame:
    """A7 in encoded form: ``(by.., feature, value, label, n)``."""
    return joint_counts(rcases, rule_spec(spec), by)


def decode_pair(col: str, a: str, b: str) -> list:
    parts = F.split(F.col(col), SEP, 2)
    return [parts.getItem(0).alias(a), parts.getItem(1).alias(b)]


def rule_pair_counts(rjoint: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., feature, from_value, to_value, n)``."""
    return value_counts(rjoint, by).select(*by, "feature",
                                           *decode_pair("value", "from_value", "to_value"), "n")


def rule_vdm(rjoint: DataFrame, by: Sequence[str] = (), dense: bool = True) -> DataFrame:
    """V2: ``(by.., feature, from1, to1, from2, to2, vdm)`` with pair1 < pair2."""
    v = vdm(rjoint, by, dense=dense)
    return v.select(*by, "feature", *decode_pair("v1", "from1", "to1"),
                    *decode_pair("v2", "from2", "to2"), "vdm")


def antecedents(queries: DataFrame, neighbours: DataFrame, cases: DataFrame, spec: FeatureSpec,
                by: Sequence[str] = ()) -> DataFrame:
    """Per query and base neighbour, the change from base to query.

    ``(by.., query_id, base_id, base_rank, base_label, <f>)`` with change-pair
    strings for categorical and ``base - query`` for numeric features.
    """
    by = list(by)
    q = queries.select(*by, F.col(spec.id).alias("query_id"),
                       *[F.col(f).alias(f"{f}_q") for f in spec.order])
    b = cases.select(*by, F.col(spec.id).alias("base_id"), F.col(spec.label).alias("base_label"),
                     *[F.col(f).alias(f"{f}_b") for f in spec.order])
    nb = neighbours.select(*by, "query_id", F.col("case_id").alias("base_id"),
                           F.col("rank").alias("base_rank"))
    j = nb.join(q, on=[*by, "query_id"]).join(b, on=[*by, "base_id"])
    return antecedents_from(j, spec, by)


def antecedents_from(nb: DataFrame, spec: FeatureSpec, by: Sequence[str] = (),
                     keep: Sequence[str] = ()) -> DataFrame:
    """R5 as a projection of neighbours carrying ``base_label``, ``<f>_b``, ``<f>_q``."""
    cols = [*by, "query_id", *keep, "base_id", "base_rank", "base_label"]
    for f in spec.order:
        a, c = F.col(f"{f}_b"), F.col(f"{f}_q")
        cols.append((_pair(a, c) if spec.kind(f) == "cat" else (a - c)).alias(f))
    return nb.select(*cols)


def nearest_rules(ante: DataFrame, rcases: DataFrame, spec: FeatureSpec, metric, rno: int,
                  by: Sequence[str] = (), n_ante: int | None = None,
                  n_rules: int | None = None, keep: Sequence[str] = (),
                  use_profiles: bool = False, lines: bool = True) -> DataFrame:
    """J3 + D2 + K7: the ``rno`` closest rules with ``from_label = base_label``.

    Ordered by ``(rule distance, src_id, dst_id, direction)``.  The label is an
    equality key of the search, so the dominant class is split into blocks (with one number: into slabs of the
    number line, of which an antecedent is sent only to those within its bound) like
    any other key instead of landing in one task.
    Returns ``(by.., query_id, base_id, base_rank, src_id, dst_id, direction,
    rule_rank, rule_distance, to_label)``.
    """
    by = list(by)
    keep = list(keep)
    left = ante.select(*by, F.col("base_label").alias("_cls"), "query_id", "base_id",
                       "base_rank", *keep, *spec.order)
    right = rcases.select(*by, F.col("from_label").alias("_cls"), *RULE_KEY, "to_label",
                          *spec.order)
    top = None
    if use_profiles:
        top = profile_topk(left, right, feats=spec.order,
                           left_key=["query_id", "base_id", "base_rank"], right_key=RULE_KEY,
                           eq=[*by, "_cls"], k=rno, kernel=metric.kernel, attach=metric.attach,
                           left_payload={c: c for c in keep},
                           right_payload={"to_label": "to_label"})
    else:
        top = line_search(left, right, feats=spec.order, left_key=["query_id", "base_id", "base_rank"],
                          right_key=RULE_KEY, eq=[*by, "_cls"], k=rno, metric=metric, n_left=n_ante,
                          n_right=n_rules, left_payload={c: c for c in keep},
                          right_payload={"to_label": "to_label"}) if lines else None
    if top is None:
        search = search_for(spec, n_rules)
        top = search(left, right, left_key=["query_id", "base_id", "base_rank"],
                     right_key=RULE_KEY, eq=[*by, "_cls"], k=rno,
                     kernel=metric.kernel, attach=metric.attach, n_left=n_ante, n_right=n_rules,
                     left_payload={c: c for c in keep},
                     right_payload={"to_label": "to_label"})
    return top.select(*by, "query_id", *keep, "base_id", "base_rank", *RULE_KEY,
                      F.col("rank").alias("rule_rank"), F.col("distance").alias("rule_distance"),
                      "to_label")


__all__ = ["rules", "rule_cases", "rule_spec", "rule_class_counts", "rule_joint_counts",
           "rule_pair_counts", "rule_vdm", "antecedents", "nearest_rules", "class_counts", "SEP",
           "RULE_KEY"]
