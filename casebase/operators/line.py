"""Exact top-k search on number lines (J2, K1, K2, K7 with one numeric feature).

Rows with equal features are at equal distances: a vector of features keeps its ``k`` smallest right keys
(a partial group limit) and is searched once on the left, and every left row takes its vector's ranking.

The right rows of an equality key are cut by quantiles of their number into slabs of about
``SLAB_ROWS`` rows of all categorical values; a slab is searched by places on lines
(:class:`~casebase.functions.line.LineBlock`).  A query is searched in the slab of its own number; the k-th
distance found there bounds the numbers that can matter, and the query is sent to the other slabs that they
reach (mostly none).  Rows are those of the plain search; no pair of blocks meets
that the bound excludes, so work grows with the rows of both sides.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.line import LineKernel
from ..session import cut_lineage, ship_package
from .topk import MOST_TASKS, blocked_topk, key_grid

SLAB_ROWS = 65_536
LEAST_ROWS = 32_768          # right rows up to which the plain search has one block of them
LEFT_ROWS = 32_768
PIECE_ROWS = 512             # left rows of one profile that stay together
MOST_KEYS = 5_000            # equality keys with edges of their own
MOST_SLABS = 5_000           # of all keys
MOST_VALUES = 2_000          # values of a categorical feature and key
MOST_COPIES = 50             # rows of one key, where a key does not find itself


def line_kernel(metric) -> LineKernel | None:
    """The metric as tables in the tasks, if it has one number and is small; else None."""
    spec, by = metric.spec, list(metric.by)
    if len(spec.numeric) != 1 or not metric.small:
        return None
    if metric.line is None:
        vectors: dict = {}
        for r in metric.vectors.collect():           # below BROADCAST_BYTES (measured)
            known = vectors.setdefault((tuple(r[b] for b in by), r["feature"]), {})
            known[r["value"]] = json.loads(r["counts"])
        if any(len(v) > MOST_VALUES for v in vectors.values()):
            return None
        spreads = {tuple(r[b] for b in by): r["sigma"] for r in metric.sigma.collect()}   # a row a key
        tables = metric.vectors.sparkSession.sparkContext.broadcast((vectors, spreads))
        metric.line = LineKernel(tuple(spec.order), spec.numeric[0], tuple(by), tables)
    return metric.line


def _edges(right: DataFrame, eq: list, number: str, slab_rows: int) -> dict | None:
    """Equality key -> the numbers at which its slabs begin, but the first; None with too many keys."""
    sizes = right.groupBy(*eq).agg(F.count(F.lit(1)).alias("n")).limit(MOST_KEYS + 1).collect()
    if len(sizes) > MOST_KEYS:
        return None
    largest = max((r["n"] for r in sizes), default=0)
    total = sum(r["n"] for r in sizes)
    slab_rows = max(slab_rows, math.ceil(total / MOST_SLABS))
    m = max(1, math.ceil(largest / slab_rows))
    at = F.array(*[F.lit(i / m) for i in range(1, m)]) if m > 1 else F.array(F.lit(0.5))
    known = F.when(~F.isnan(number), F.col(number))
    found = right.groupBy(*eq).agg(F.count(F.lit(1)).alias("n"), F.min(known).alias("least"),
                                   F.percentile_approx(known, at, max(10_000, 20 * m)).alias("cuts")).collect()
    out = {}
    for r in found:
        own = max(1, math.ceil(r["n"] / slab_rows))
        cuts = r["cuts"] or []
        take = {min(m - 2, max(0, round(j * m / own) - 1)) for j in range(1, own)} if m > 1 else set()
        out[tuple(r[c] for c in eq)] = np.array(sorted({cuts[i] for i in take if cuts and cuts[i] > r["least"]}),
                                                dtype=np.float64)
    return out


def line_topk(left: DataFrame, right: DataFrame, *, left_key: Sequence[str], right_key: Sequence[str], k: int,
              kernel: LineKernel, eq: Sequence[str] = (), right_payload: dict | None = None,
              n_left: int | None = None, n_right: int | None = None, slab_rows: int = SLAB_ROWS,
              left_rows: int = LEFT_ROWS) -> DataFrame | None:
    """The contract of ``blocked_topk`` without excluded pairs; None if the equality keys are too many."""
    left_key, right_key, eq, number = list(left_key), list(right_key), list(eq), kernel.number
    spark = left.sparkSession
    ship_package(spark)
    options = dict(left_key=left_key, right_key=right_key, k=k, kernel=kernel, attach=lambda rows: rows,
                   right_payload=right_payload)
    if n_right is not None and n_right <= slab_rows:
        return blocked_topk(left, right, eq=eq, n_left=n_left, n_right=n_right, left_block_rows=left_rows,
                            right_block_rows=slab_rows, **options)
    right = cut_lineage(right)
    edges = _edges(right, eq, number, slab_rows)
    if edges is None:
        return None
    keys = list(edges)
    shared = spark.sparkContext.broadcast([edges[x] for x in keys])
    spreads = kernel.tables

    @F.pandas_udf("int")
    def slab(code: pd.Series, x: pd.Series) -> pd.Series:
        out, code, x = np.zeros(len(x), np.int32), code.to_numpy(), x.to_numpy(dtype=np.float64)
        for c in np.unique(code):
            own = (code == c) & ~np.isnan(x)                       # missing: the first
            out[own] = np.searchsorted(shared.value[c], x[own], side="right")
        return pd.Series(out)

    if eq:
        codes = spark.createDataFrame([(*x, i) for i, x in enumerate(keys)], T.StructType(
            [T.StructField(c, right.schema[c].dataType) for c in eq] + [T.StructField("_code", T.IntegerType())]))
        L, R = left.join(F.broadcast(codes), eq), right.join(F.broadcast(codes), eq)
    else:
        L, R = left.withColumn("_code", F.lit(0)), right.withColumn("_code", F.lit(0))
    R = cut_lineage(R.withColumn("_slab", slab("_code", number)).drop("_code"))
    L = cut_lineage(L.withColumn("_slab", slab("_code", number)))
    at = [*eq, "_slab"]
    # every left row in its own slab: the rows found there, and the other slabs that can hold a nearer one
    blocks = key_grid(L, R, at, left_rows, 1 << 30, 2 * spark.sparkContext.defaultParallelism, R.count()).select(*at, "_lbn")
    lhash = F.xxhash64(*[F.col(c) for c in left_key])
    # left rows of like categorical values meet a block together, in pieces, so a frequent profile is spread
    profile = F.xxhash64(*[F.col(c) for c in kernel.order if c != number], F.lit(0))
    asked = L.withColumn("_profile", profile)
    sizes = asked.groupBy(*at, "_profile").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias("_pieces"))
    asked = asked.join(F.broadcast(blocks), at).join(sizes, [*at, "_profile"]).withColumn("_lb", F.pmod(F.xxhash64(
        "_profile", F.pmod(lhash, F.col("_pieces"))), F.col("_lbn")).cast("int")).drop("_lbn", "_profile", "_pieces")
    home = R.join(F.broadcast(blocks), at).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), F.col("_lbn") - 1))).drop("_lbn")
    # a fixed number of tasks: few bytes can be much work, so small partitions are not put together
    spread = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked, home = (x.repartition(min(spread, MOST_TASKS), *at, "_lb") for x in (asked, home))
    asked, home = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (asked, home))
    carried, pay = list(left.columns), dict(right_payload or {})
    schema = T.StructType(
        [T.StructField(c, left.schema[c].dataType) for c in carried]
        + [T.StructField(c, right.schema[c].dataType) for c in right_key]
        + [T.StructField(o, right.schema[c].dataType) for o, c in pay.items()]
        + [T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType()),
           T.StructField("_home", T.IntegerType()), T.StructField("_from", T.IntegerType()),
           T.StructField("_to", T.IntegerType()), T.StructField("_t", T.DoubleType())])
    names = schema.fieldNames()

    def reach(group, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        rpdf = rpdf.sort_values(right_key, kind="mergesort").reset_index(drop=True)
        block = kernel.block(lpdf, rpdf)
        best, cols = block.topk(k)
        rows, rank = np.nonzero(np.isfinite(best))
        found = lpdf[carried].iloc[rows].reset_index(drop=True)
        taken = rpdf.iloc[cols[rows, rank]]
        for o, c in ({c: c for c in right_key} | pay).items():
            found[o] = taken[c].to_numpy()
        found["distance"], found["rank"] = best[rows, rank], (rank + 1).astype(np.int32)
        found["_home"], found["_from"], found["_to"], found["_t"] = 0, -1, -1, np.nan
        t, own = best[:, -1].copy(), int(lpdf["_slab"].iloc[0])
        cuts, x = shared.value[int(lpdf["_code"].iloc[0])], block.x
        t[np.isnan(x)] = np.inf
        near = t < 1.0 - 1e-9                   # beyond, rows at the cap of the term or without a number count too
        r = np.zeros(len(x)) if block.flat else 4.0 * block.sigma * np.where(near, t, 0.0) ** 2 * (1 + 1e-6)
        r = r + np.abs(x) * 1e-12
        first = np.where(near, np.searchsorted(cuts, x - r, side="right"), 0)
        last = np.where(near, np.searchsorted(cuts, x + r, side="right"), len(cuts))
        beyond = np.flatnonzero((first < own) | (last > own))
        if not len(beyond):
            return found[names]
        more = lpdf[carried].iloc[beyond].reset_index(drop=True)
        for c in [*right_key, *pay]:
            more[c] = pd.Series([None] * len(more), dtype=object)
            found[c] = found[c].astype(object)
        more["distance"], more["rank"], more["_home"] = np.nan, 0, own
        more["_from"], more["_to"], more["_t"] = first[beyond], last[beyond], t[beyond]
        return pd.concat([found[names], more[names]], ignore_index=True)

    found = asked.groupBy(*at, "_lb").cogroup(home.groupBy(*at, "_lb")).applyInPandas(reach, schema)
    out = [*eq, *left_key, *right_key, *pay, "distance", "rank"]
    w = Window.partitionBy(*eq, *left_key).orderBy("distance", *right_key)
    if all(len(x) == 0 for x in edges.values()):
        found = found.select(*out)
        if not eq:
            return found
    else:
        found = cut_lineage(found)
        sent = found.where("_from >= 0").withColumn("_slab", F.explode(F.sequence("_from", "_to"))).where(
            "_slab <> _home").select(*carried, "_slab", "_t")
        others = blocked_topk(sent, R, eq=at, within="_t", merge=False, left_block_rows=left_rows,
                              right_block_rows=1 << 30, n_left=n_left, n_right=n_right or 1, **options)
        found = found.where("_from < 0").select(*out).unionByName(others.select(*out))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _copies(rows: DataFrame, key: list) -> int:
    """The most rows that share a key; NULL is not a key."""
    return rows.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in key))).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 1


def line_search(left: DataFrame, right: DataFrame, *, feats: Sequence[str], left_key: Sequence[str],
                right_key: Sequence[str], k: int, metric, eq: Sequence[str] = (),
                exclude_self: tuple[str, str] | None = None, n_left: int | None = None,
                n_right: int | None = None, left_payload: dict | None = None,
                right_payload: dict | None = None, least_rows: int = LEAST_ROWS, **sizes) -> DataFrame | None:
    """The contract of ``blocked_topk`` by number lines; None where they do not serve: few right rows, not exactly one
    number, a metric or a list of equality keys too large for tables, or a key of too many rows."""
    kernel = line_kernel(metric) if n_right is None or n_right > least_rows else None
    if kernel is None:
        return None
    feats, lk, rk, eq = list(feats), list(left_key), list(right_key), list(eq)
    lp, rp = dict(left_payload or {}), dict(right_payload or {})
    copies = _copies(right, [*eq, exclude_self[1]]) if exclude_self else _copies(left, [*eq, *lk]) if eq else 1
    if exclude_self and copies > MOST_COPIES:
        return None
    kk = k + copies if exclude_self else k
    w = Window.partitionBy(*eq, *feats).orderBy(*rk)
    kept = (right.select(*eq, *rk, *feats, *[F.col(c).alias(f"_rp_{o}") for o, c in rp.items()])
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= kk).drop("_r"))
    rows = left.select(*eq, *lk, *feats, *[F.col(c).alias(f"_lp_{o}") for o, c in lp.items()])
    there = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in lk))
    vectors = (rows.groupBy(*eq, *feats).agg(F.min(F.when(there, F.struct(*lk))).alias("_qk"))
               .select(*eq, *feats, *[F.col(f"_qk.{c}").alias(f"_qk_{c}") for c in lk]))
    qk = [f"_qk_{c}" for c in lk]
    top = line_topk(vectors.select(*eq, *qk, *feats), kept, left_key=qk, right_key=rk, eq=eq, k=kk, kernel=kernel,
                    right_payload={f"_rp_{o}": f"_rp_{o}" for o in rp}, n_left=n_left, n_right=n_right, **sizes)
    if top is None:
        return None
    # a row a vector: its ranking, of kk rows at most
    ranked = top.groupBy(*eq, *qk).agg(F.sort_array(F.collect_list(F.struct(
        "rank", *rk, *[f"_rp_{o}" for o in rp], "distance"))).alias("_list"))
    # null-safe: a NULL value is a value of its own, as in the plain search
    m, v = rows.alias("_m"), vectors.alias("_v")
    members = m.join(v, [F.col(f"_m.{c}").eqNullSafe(F.col(f"_v.{c}")) for c in [*eq, *feats]]).select(
        *[F.col(f"_m.{c}") for c in [*eq, *lk]], *[F.col(f"_m._lp_{o}") for o in lp], *[F.col(f"_v.{c}") for c in qk])
    out = members.join(ranked, [*eq, *qk])
    if exclude_self:
        a, b = exclude_self
        out = out.withColumn("_list", F.slice(F.filter(
            "_list", lambda x: F.coalesce(x[b] != F.col(a), F.lit(True))), 1, k))
    out = out.select(*eq, *lk, *[F.col(f"_lp_{o}").alias(o) for o in lp], F.posexplode("_list").alias("_at", "_x"))
    out = out.select(*eq, *lk, *lp, *[F.col(f"_x.{c}").alias(c) for c in rk],
                     *[F.col(f"_x._rp_{o}").alias(o) for o in rp], F.col("_x.distance").alias("distance"),
                     (F.col("_at") + 1).cast("int").alias("rank"))
    if eq and copies > 1:                     # left rows of one key share a ranking, as in the plain search
        w = Window.partitionBy(*eq, *lk).orderBy("distance", *rk)
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out
