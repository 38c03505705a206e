"""Blocked exact top-k search between two DataFrames.

Exact nearest-neighbour search under a learned metric has to look at every
(left, right) combination, but it must not *emit* them.  The operator
therefore works on a grid of blocks:

* every left row gets a block ``lb = pmod(xxhash64(left key), Lb)`` and every
  right row ``rb = pmod(xxhash64(right key), Rb)``;
* left rows are replicated to all ``Rb`` right blocks and right rows to all
  ``Lb`` left blocks, then both sides are co-grouped on
  ``(eq keys, lb, rb)``;
* each group looks for the ``k`` best right rows per left row in cells with lower bounds
  (``kernels.Cells``), so most distances are never computed, and emits only those;
* a ``row_number() <= k`` window (planned as a partial ``WindowGroupLimit``
  before the shuffle) merges the per-block winners.

Blocks come from hashing unique keys, so a hot equality key (one class holding
a third of all rules) is spread over ``Lb * Rb`` groups like every other key,
and no group ever holds more than about ``left_block_rows * right_block_rows``
pairs.  With equality keys the grid of each key is a row of a small table, computed
from the key's counts on *both* sides and joined to them; only two row counts reach
the driver.  Ties are broken by the right key, so results are deterministic
and independent of partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import CHUNK_CELLS, Kernel, topk_weighted
from ..session import ship_package

MOST_TASKS = 4096            # tasks that the blocks of one search are spread over, at most
COMPARED = None              # an accumulator that is told how many pairs the searches look at (benchmark)


def _grid(n_left: int, n_right: int, left_block_rows: int, right_block_rows: int,
          min_groups: int) -> tuple[int, int]:
    rb = max(1, math.ceil(n_right / right_block_rows))
    lb = max(1, math.ceil(n_left / left_block_rows))
    if lb * rb < min_groups:
        lb = max(lb, min(math.ceil(min_groups / rb), max(1, n_left // 64)))
    return lb, rb


def key_grid(left: DataFrame, right: DataFrame, eq: Sequence[str], left_block_rows: int,
             right_block_rows: int, min_groups: int, n_right: int) -> DataFrame:
    """``(eq.., _lbn, _rbn)``: the blocks of every equality key, from its counts on both sides."""
    eq = list(eq)
    nl = left.groupBy(*eq).agg(F.count(F.lit(1)).alias("_nl"))
    nr = right.groupBy(*eq).agg(F.count(F.lit(1)).alias("_nr"))
    share = F.greatest(F.lit(1), F.round(F.col("_nr") * (min_groups / max(1, n_right)))).cast("int")
    rb = F.ceil(F.col("_nr") / right_block_rows).cast("int")
    lb = F.ceil(F.col("_nl") / left_block_rows).cast("int")
    more = F.least(F.ceil(share / F.col("_rbn")), F.greatest(F.lit(1), F.floor(F.col("_nl") / 64)))
    return (nl.join(nr, eq).withColumn("_rbn", rb).withColumn(
        "_lbn", F.when(lb * F.col("_rbn") < share, F.greatest(lb, more)).otherwise(lb).cast("int"))
        .select(*eq, "_lbn", "_rbn"))


def blocked_topk(left: DataFrame, right: DataFrame, *, left_key: Sequence[str],
                 right_key: Sequence[str], k: int, kernel: Kernel,
                 attach: Callable[[DataFrame], DataFrame],
                 eq: Sequence[str] = (), exclude_self: tuple[str, str] | None = None,
                 left_block_rows: int | None = None, right_block_rows: int = 32768,
                 min_groups: int | None = None, n_left: int | None = None,
                 n_right: int | None = None, left_payload: dict | None = None,
                 right_payload: dict | None = None, weight: str | None = None,
                 merge: bool = True, within: str | None = None) -> DataFrame:
    """Top-``k`` right rows per left row, by ``(distance, right key)``.

    ``attach`` adds the kernel's metric columns to the rows of a side.
    ``n_left``/``n_right`` are size hints for the grid (counted when absent; a hint
    avoids re-running an expensive upstream plan just to size blocks).
    ``left_payload`` / ``right_payload`` map output names to input columns copied onto every
    result row, so callers need no join back to either side.  Returns
    ``(eq.., left_key.., left payload.., right_key.., right payload.., distance,
    rank)``.

    With ``merge=False`` the winners of the blocks are returned as they are, each with its
    rank in its block, for a caller that ranks them itself; ``within`` names a left column with
    the largest distance that matters.

    With ``weight`` (a right column), right rows are profiles standing for
    that many cases: each left row keeps the profiles up to the distance at
    which the cumulative weight reaches ``k`` (see ``topk_weighted``); the
    result is unranked and the caller expands and ranks the cases.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    left_key, right_key, eq = list(left_key), list(right_key), list(eq)
    lpay, rpay = dict(left_payload or {}), dict(right_payload or {})
    spark = left.sparkSession
    ship_package(spark)
    if left_block_rows is None:
        left_block_rows = kernel.left_rows
    if min_groups is None:
        min_groups = 2 * spark.sparkContext.defaultParallelism
    n_right = right.count() if n_right is None else n_right
    lhash = F.xxhash64(*[F.col(c) for c in left_key])
    rhash = F.xxhash64(*[F.col(c) for c in right_key])
    if eq:
        grid = key_grid(left, right, eq, left_block_rows, right_block_rows, min_groups, n_right)
        L = attach(left).join(grid, on=eq)
        R = attach(right).join(grid, on=eq)
        L = L.withColumn("_lb", F.pmod(lhash, F.col("_lbn")).cast("int")).withColumn(
            "_rb", F.explode(F.sequence(F.lit(0), F.col("_rbn") - 1))).drop("_lbn", "_rbn")
        R = R.withColumn("_rb", F.pmod(rhash, F.col("_rbn")).cast("int")).withColumn(
            "_lb", F.explode(F.sequence(F.lit(0), F.col("_lbn") - 1))).drop("_lbn", "_rbn")
        rb = None
    else:
        n_left = left.count() if n_left is None else n_left
        lb, rb = _grid(n_left, n_right, left_block_rows, right_block_rows, min_groups)
        L = attach(left).withColumn("_lb", F.pmod(lhash, F.lit(lb)).cast("int")).withColumn(
            "_rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))) if rb > 1 else F.lit(0))
        R = attach(right).withColumn("_rb", F.pmod(rhash, F.lit(rb)).cast("int")).withColumn(
            "_lb", F.explode(F.sequence(F.lit(0), F.lit(lb - 1))) if lb > 1 else F.lit(0))
    if getattr(kernel, "wide", False):
        # the spreads of many numbers are as large as the numbers: the left rows, which are fewer in a block, carry them
        R = R.drop(*[c for c in kernel.columns() if c.startswith("_s_")])
    spread = 0 if eq else min(2 * lb * rb, MOST_TASKS)
    if spread > int(spark.conf.get("spark.sql.shuffle.partitions")):
        # blocks grow with the product of the sides: tasks with them, so none gets ever more blocks
        L, R = (x.repartition(spread, "_lb", "_rb") for x in (L, R))
    # fresh attributes on both sides: a self search co-groups one lineage with itself
    L = L.select(*[F.col(c).alias(c) for c in L.columns])
    R = R.select(*[F.col(c).alias(c) for c in R.columns])

    fields = ({f.name: f for f in left.schema.fields} | {f.name: f for f in right.schema.fields})
    out_schema = T.StructType(
        [T.StructField(c, fields[c].dataType) for c in eq]
        + [T.StructField(c, left.schema[c].dataType) for c in left_key]
        + [T.StructField(o, left.schema[c].dataType) for o, c in lpay.items()]
        + [T.StructField(c, right.schema[c].dataType) for c in right_key]
        + [T.StructField(o, right.schema[c].dataType) for o, c in rpay.items()]
        + [T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    out_cols = [f.name for f in out_schema.fields]
    self_l, self_r = exclude_self if exclude_self else (None, None)
    compared = COMPARED

    def run(key, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            # object dtype: an empty float column would not convert to a string field
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in out_cols})
        rpdf = rpdf.sort_values(right_key, kind="mergesort").reset_index(drop=True)
        block = kernel.block(lpdf, rpdf)          # both sides encoded once per group
        self_values = (lpdf[self_l].to_numpy(), rpdf[self_r].to_numpy()) if self_l is not None else None

        def hide(d, rows, cols):
            if self_values is None:
                return d
            return np.where(self_values[0][rows][:, None] == self_values[1][cols][None, :], np.inf, d)

        def found():
            if weight is None:
                limit = None if within is None else lpdf[within].to_numpy(dtype=np.float64)
                yield from block.nearest(k, hide, limit, compared)
                return
            chunk, cols, weights = max(1, CHUNK_CELLS // len(rpdf)), np.arange(len(rpdf)), \
                rpdf[weight].to_numpy(np.float64)
            for start in range(0, len(lpdf), chunk):
                rows = np.arange(start, min(start + chunk, len(lpdf)))
                d = hide(block.distances(start, start + len(rows)), rows, cols)
                i, j, values = topk_weighted(d, weights, k)
                yield i + start, j, values, np.zeros(len(i), dtype=np.int32)

        parts = []
        for rows, cols, vals, rank in found():
            part = {}
            for i, c in enumerate(eq):
                part[c] = [key[i]] * len(rows)
            for c in left_key:
                part[c] = lpdf[c].to_numpy()[rows]
            for o, c in lpay.items():
                part[o] = lpdf[c].to_numpy()[rows]
            for c in right_key:
                part[c] = rpdf[c].to_numpy()[cols]
            for o, c in rpay.items():
                part[o] = rpdf[c].to_numpy()[cols]
            part["distance"] = vals
            part["rank"] = rank.astype(np.int32)
            parts.append(pd.DataFrame(part, columns=out_cols))
        return pd.concat(parts, ignore_index=True)

    winners = (L.groupBy(*eq, "_lb", "_rb")
               .cogroup(R.groupBy(*eq, "_lb", "_rb"))
               .applyInPandas(run, schema=out_schema))
    if rb == 1 or weight is not None or not merge:
        # one right block: every left row met all right rows in a single group,
        # so the per-group ranking is already final (no merge shuffle)
        return winners
    w = Window.partitionBy(*eq, *left_key).orderBy("distance", *right_key)
    return (winners.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))
