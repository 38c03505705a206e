"""Exact top-k search over distinct feature profiles.

Rows with identical feature vectors are at identical distances from every
query.  On categorical case bases the number of distinct vectors is bounded
by the product of the feature arities, not by the number of rows, so the
search runs on profiles:

1. every right profile keeps its ``k`` smallest right keys - a ``row_number``
   group limit that Spark applies partially before the shuffle, so a profile
   holding a third of all rows is cut to ``k`` rows in every map task;
2. distinct left profiles are searched against right profiles with a
   count-weighted selection: all profiles up to the distance where the kept
   rows reach ``k``, with the ties that can hold a result (``topk_weighted``);
3. the selected profiles are expanded to their kept keys and ranked by
   ``(distance, right key)``; left rows join their profile's ranking.

The result is identical, row for row, to the plain blocked search; it is used
for case neighbours (K1, K2) and rule retrieval (K7) when every feature is
categorical.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import blocked_topk


def profile_topk(left: DataFrame, right: DataFrame, *, feats: Sequence[str],
                 left_key: Sequence[str], right_key: Sequence[str], k: int, kernel, attach,
                 eq: Sequence[str] = (),
                 left_payload: dict | None = None, right_payload: dict | None = None,
                 exclude_self: tuple[str, str] | None = None) -> DataFrame:
    """Same contract as ``blocked_topk``: ``(eq.., left_key.., left payload..,
    right_key.., right payload.., distance, rank)``."""
    feats, lk, rk, eq = list(feats), list(left_key), list(right_key), list(eq)
    lp, rp = dict(left_payload or {}), dict(right_payload or {})
    kk = k + 1 if exclude_self else k

    r = right.select(*eq, *rk, *feats, *[F.col(c).alias(f"_rp_{o}") for o, c in rp.items()])
    w = Window.partitionBy(*eq, *feats).orderBy(*rk)
    kept = r.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= kk)
    prof = (kept.groupBy(*eq, *feats)
            .agg(F.min(F.struct(*rk)).alias("_pk"), F.count(F.lit(1)).alias("_w"),
                 # at most kk entries per profile (group limit above)
                 F.collect_list(F.struct(*rk, *[f"_rp_{o}" for o in rp])).alias("_ids"))
            .select(*eq, *feats, "_w", "_ids", *[F.col(f"_pk.{c}").alias(f"_pk_{c}") for c in rk]))
    pkeys = [f"_pk_{c}" for c in rk]

    lsel = left.select(*eq, *lk, *feats, *[F.col(c).alias(f"_lp_{o}") for o, c in lp.items()])
    lprof = (lsel.groupBy(*eq, *feats).agg(F.min(F.struct(*lk)).alias("_qk"))
             .select(*eq, *feats, *[F.col(f"_qk.{c}").alias(f"_qk_{c}") for c in lk]))
    qkeys = [f"_qk_{c}" for c in lk]

    sel = blocked_topk(lprof, prof.select(*eq, *pkeys, "_w", *feats), left_key=qkeys,
                       right_key=pkeys, eq=eq, k=kk, kernel=kernel, attach=attach,
                       weight="_w")
    cand = (sel.join(prof.select(*eq, *pkeys, "_ids"), [*eq, *pkeys])
            .select(*eq, *qkeys, "distance", F.explode("_ids").alias("_c"))
            .select(*eq, *qkeys, "distance", "_c.*"))
    wr = Window.partitionBy(*eq, *qkeys).orderBy("distance", *rk)
    top = cand.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= kk)

    # null-safe: a NULL categorical value is a value of its own, as in the plain search
    ml, mr = lsel.alias("_m"), lprof.alias("_p")
    cond = [F.col(f"_m.{c}").eqNullSafe(F.col(f"_p.{c}")) for c in [*eq, *feats]]
    members = ml.join(mr, cond).select(*[F.col(f"_m.{c}") for c in [*eq, *lk]],
                                       *[F.col(f"_p.{c}") for c in qkeys],
                                       *[F.col(f"_m._lp_{o}") for o in lp])
    out = members.join(top, [*eq, *qkeys])
    if exclude_self:
        a, b = exclude_self
        out = out.where(F.col(a) != F.col(b))
        wq = Window.partitionBy(*eq, *lk).orderBy("distance", *rk)
        out = out.withColumn("rank", F.row_number().over(wq)).where(F.col("rank") <= k)
    return out.select(*eq, *lk, *[F.col(f"_lp_{o}").alias(o) for o in lp], *rk,
                      *[F.col(f"_rp_{o}").alias(o) for o in rp], "distance", "rank")
