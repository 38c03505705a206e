"""Classification by neighbour vote (C2) and by ensembles of adaptations.

The neighbour search carries everything the later steps read (the query's
true label and features, the neighbour's label and features) as payload, so
labels, antecedents and votes are projections and bounded aggregations of the
search output: no join back to the case tables on possibly skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import rules as R
from .neighbors import nearest, with_labels
from .vote import vote_bounded


def neighbours_with_payload(queries: DataFrame, model, k: int,
                            n_queries: int | None = None) -> DataFrame:
    """K1 plus the columns C2/C3 need: ``label``, ``case_label``/``base_label``,
    ``<f>_q`` and ``<f>_b``."""
    spec = model.spec
    qp = {"label": spec.label, **{f"{f}_q": f for f in spec.order}}
    cp = {"case_label": spec.label, **{f"{f}_b": f for f in spec.order}}
    nb = nearest(queries, model, k, n_queries, query_payload=qp, case_payload=cp)
    return nb.withColumn("base_label", F.col("case_label"))


def every_query(queries: DataFrame, model, votes: DataFrame, with_truth: bool) -> DataFrame:
    """One row a query: its vote, or NULL if nothing could vote."""
    spec, by = model.spec, list(model.by)
    asked = queries.select(*by, F.col(spec.id).alias("query_id"), F.col(spec.label).alias("label"))
    votes = votes.select(*by, "query_id", "prediction")
    out = asked.join(votes, [*by, "query_id"], "left").select(*by, "query_id", "label", "prediction")
    return out if with_truth else out.drop("label")


def knn_classify(queries: DataFrame, model, k: int, neighbours: DataFrame | None = None,
                 with_truth: bool = True) -> DataFrame:
    """``(by.., query_id, label, prediction)`` by majority of the k nearest labels;
    one row a query, with a NULL prediction if no neighbour has a label."""
    spec, by = model.spec, list(model.by)
    if neighbours is None:
        nb = nearest(queries, model, k, case_payload={"case_label": spec.label})
    else:
        nb = neighbours
        if "case_label" not in nb.columns:
            nb = with_labels(nb, model)
    votes = vote_bounded(nb.where(F.col("rank") <= k), [*by, "query_id"], "case_label")
    return every_query(queries, model, votes, with_truth)


def adaptation_votes(queries: DataFrame, model, k: int, rno: int,
                     neighbours: DataFrame | None = None, keep_label: bool = False) -> DataFrame:
    """R5 + J3 + D2 + K7: the chosen rules of every (query, base neighbour)."""
    if model.rules is None:
        raise ValueError("model was fitted without rules (radius)")
    spec, by = model.spec, list(model.by)
    n_queries = queries.count()
    if neighbours is None:
        nb = neighbours_with_payload(queries, model, k, n_queries)
    else:
        nb = neighbours
    nb = nb.where(F.col("rank") <= k).withColumnRenamed("case_id", "base_id") \
        .withColumnRenamed("rank", "base_rank")
    keep = ["label"] if keep_label else []
    # at most k antecedents per query, read by the grid, the profiles and the search:
    # materialised once, as the rule table is at fit
    ante = cut_lineage(R.antecedents_from(nb, spec, by, keep))
    return R.nearest_rules(ante, model.rule_cases, spec, model.rule_metric, rno, by,
                           n_ante=n_queries * k, n_rules=model.n_rules, keep=keep,
                           use_profiles=getattr(model, "use_profiles", False),
                           lines=getattr(model, "compress", None) is None)


def adapt_classify(queries: DataFrame, model, k: int, rno: int,
                   neighbours: DataFrame | None = None, with_truth: bool = True) -> DataFrame:
    """Every base neighbour's label is adapted by its ``rno`` closest rules
    (vote over their target labels), then the bases vote; one row a query."""
    by = list(model.by)
    chosen = adaptation_votes(queries, model, k, rno, neighbours)
    per_base = vote_bounded(chosen, [*by, "query_id", "base_id"], "to_label", "target")
    return every_query(queries, model, vote_bounded(per_base, [*by, "query_id"], "target"), with_truth)
