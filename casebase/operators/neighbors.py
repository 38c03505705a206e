"""Neighbour search over a case base (J2, J4, K1-K7 minus the all-pairs forms).

All searches go through :func:`blocked_topk`, with one numeric feature on number lines
(:mod:`casebase.operators.line`); the learned metric comes as columns of
the rows (:mod:`casebase.operators.metric`), so its size is not bounded by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import FeatureSpec
from .bounded import search_for
from .compressed import profile_topk
from .line import line_search


def _side(df: DataFrame, spec: FeatureSpec, by: Sequence[str], key: str,
          extra: Sequence[str] = ()) -> DataFrame:
    cols = list(dict.fromkeys([*spec.order, *extra]))
    return df.select(*by, F.col(spec.id).alias(key), *cols)


def _payload(spec: FeatureSpec, prefix: str, label_as: str | None) -> dict:
    out = {f"{f}_{prefix}": f for f in spec.order}
    if label_as:
        out[label_as] = spec.label
    return out


def _plain_or_bounded(left, right, model, by, k, exclude_self, n_left, lp, rp) -> DataFrame:
    n = model.n_cases
    if getattr(model, "compress", None) is None:
        res = line_search(left, right, feats=model.spec.order, left_key=["query_id"], right_key=["case_id"], k=k,
                          metric=model.metric, eq=by, exclude_self=exclude_self, n_left=n_left, n_right=n,
                          left_payload=lp, right_payload=rp)
        if res is not None:
            return res
    return search_for(model.spec, n)(
        left, right, left_key=["query_id"], right_key=["case_id"], k=k, kernel=model.metric.kernel,
        attach=model.metric.attach, exclude_self=exclude_self, n_left=n_left, n_right=n,
        left_payload=lp, right_payload=rp, eq=by)


def nearest(queries: DataFrame, model, k: int, n_queries: int | None = None,
            query_payload: dict | None = None, case_payload: dict | None = None) -> DataFrame:
    """``(by.., query_id, rank, case_id, distance)``, the ``k`` nearest
    training cases of every query by ``(distance, case_id)``.

    Fewer than ``k`` training cases: all of them are returned.  Payload maps
    (output name -> column) copy query or case columns onto the result rows.
    """
    spec, by = model.spec, list(model.by)
    qp, cp = dict(query_payload or {}), dict(case_payload or {})
    left = _side(queries, spec, by, "query_id", qp.values())
    right = _side(model.cases, spec, by, "case_id", cp.values())
    if getattr(model, "use_profiles", False):
        res = profile_topk(left, right, feats=spec.order, left_key=["query_id"],
                           right_key=["case_id"], eq=by, k=k, kernel=model.metric.kernel,
                           attach=model.metric.attach, left_payload=qp, right_payload=cp)
    else:
        res = _plain_or_bounded(left, right, model, by, k, None, n_queries, qp, cp)
    return res.select(*by, "query_id", "rank", "case_id", "distance", *qp, *cp)


def nearest_within(model, radius: int, payload: bool = False) -> DataFrame:
    """K2: leave-self-out ``radius`` nearest training cases of every training case.

    ``payload=True`` adds both cases' labels and features (``from_label``,
    ``<f>_from``, ``to_label``, ``<f>_to``), which is all a rule needs.
    """
    spec, by = model.spec, list(model.by)
    lp = _payload(spec, "from", "from_label") if payload else {}
    rp = _payload(spec, "to", "to_label") if payload else {}
    left = _side(model.cases, spec, by, "query_id", [spec.label])
    right = _side(model.cases, spec, by, "case_id", [spec.label])
    if getattr(model, "use_profiles", False):
        res = profile_topk(left, right, feats=spec.order, left_key=["query_id"],
                           right_key=["case_id"], eq=by, k=radius,
                           kernel=model.metric.kernel, attach=model.metric.attach, left_payload=lp, right_payload=rp,
                           exclude_self=("query_id", "case_id"))
    else:
        res = _plain_or_bounded(left, right, model, by, radius, ("query_id", "case_id"),
                                model.n_cases, lp, rp)
    return res.select(*by, "query_id", "rank", "case_id", "distance", *lp, *rp)


def kth_distance(neighbours: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """K3: the 0-based ``n``-th smallest distance per query (from a ranking of depth > n)."""
    return (neighbours.where(F.col("rank") == n + 1)
            .select(*by, "query_id", F.col("distance").alias("kth_distance")))


def with_labels(neighbours: DataFrame, model, col: str = "case_id",
                label_alias: str = "case_label") -> DataFrame:
    """Attach the label of a case id (equi-join on the key)."""
    spec, by = model.spec, list(model.by)
    labels = model.cases.select(*by, F.col(spec.id).alias(col), F.col(spec.label).alias(label_alias))
    return neighbours.join(labels, on=[*by, col])
