"""Exact top-k search in range cells with distance bounds (J2, K1, K2 on mixed case bases).

The right rows are sorted by (categorical values, numbers, key) into cells of about
``sqrt(n)`` rows.  A cell is summarised by the categorical values it holds and, for each
of them, the range of every number.  A query's distance to a summary is a lower bound
of its distances to the rows behind it:

1. every query is searched in its nearest cell; the k-th distance found there is an
   upper bound ``t`` of the true k-th distance;
2. the query is then sent to the cells whose lower bound is at most ``t`` and to no other,
   and the winners of those cells are ranked.

The result is that of the plain blocked search, row for row: subtraction, division, minimum,
sum and square root are monotone under rounding, the bound uses the same operations in the
same order, and ``<=`` keeps ties.  Work falls from ``n m`` to about ``n sqrt(m)`` bounds
and the rows of the few cells that are left, if the numbers are few; with many numeric
features nothing can be excluded and the plain search does as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import Kernel, Values, term_table
from ..session import cut_lineage, ship_package
from .topk import CHUNK_CELLS, blocked_topk

CELL_ROWS = 256              # least rows of a cell
QUERY_ROWS = 4096            # queries that meet summaries together
SUMMARY_ROWS = 65_536        # summaries that they meet
# rows from which queries are routed to cells between tasks, if the numbers are few; below, blocks meet whole
# and each looks at its own cells (kernels.Cells).  The rows are the same either way
BOUNDED_NUMBERS, BOUNDED_ROWS = 2, 250_000


def search_for(spec, n_right: int | None):
    """The search for a right side of ``n_right`` rows."""
    routed = 0 < len(spec.numeric) <= BOUNDED_NUMBERS and n_right is not None and n_right >= BOUNDED_ROWS
    return bounded_topk if routed else blocked_topk


def cells_of(rows: DataFrame, kernel: Kernel, by: Sequence[str], key: Sequence[str],
             cell_rows: int, n_rows: int) -> DataFrame:
    """``rows`` with ``_cell``, written once: neighbours in the sort order share a cell."""
    nums = [f for f in kernel.order if kernel.kinds[f] == "num"]
    cats = [f for f in kernel.order if kernel.kinds[f] == "cat"]
    order = [*by, *cats, *nums, *key]
    tasks = min(max(1, math.ceil(n_rows / cell_rows)),
                int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    per = max(1, math.ceil(n_rows / cell_rows)) + 1              # cells of one task at most
    return cut_lineage(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
                       .withColumn("_cell", part * F.lit(per) + F.floor(row / cell_rows)))


def summaries(cells: DataFrame, kernel: Kernel, by: Sequence[str]) -> DataFrame:
    """One row a cell and combination of categorical values (and of missing numbers)."""
    nums = [f for f in kernel.order if kernel.kinds[f] == "num"]
    cats = [f for f in kernel.order if kernel.kinds[f] == "cat"]
    gone = [(F.col(f).isNull() | F.isnan(f)).alias("_none_" + f) for f in nums]
    keys = [*by, "_cell", *cats, *[f"_none_{f}" for f in nums]]
    return cells.withColumns({"_none_" + f: g for f, g in zip(nums, gone, strict=True)}).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(f).alias("_lo_" + f) for f in nums],
        *[F.max(f).alias("_hi_" + f) for f in nums],
        *[F.max(c).alias(c) for c in kernel.columns()])


def lower_bounds(kernel: Kernel, left: pd.DataFrame, cells: pd.DataFrame, tables: dict) -> np.ndarray:
    """Lower bounds of the distances of queries to what the summaries stand for."""
    acc = np.zeros((len(left), len(cells)))
    for f in kernel.order:
        if kernel.kinds[f] == "cat":
            if f not in tables:
                tables[f] = Values.of(cells, f)
            own = Values.of(left, f)
            acc += term_table(own, tables[f])[own.codes][:, tables[f].codes]
            continue
        x = left[f].to_numpy(dtype=np.float64)[:, None]
        lo = cells["_lo_" + f].to_numpy(dtype=np.float64)[None, :]
        hi = cells["_hi_" + f].to_numpy(dtype=np.float64)[None, :]
        none = cells["_none_" + f].to_numpy(dtype=bool)[None, :] | np.isnan(x)
        s = float(cells["_s_" + f].iloc[0])
        if not np.isfinite(s) or s == 0.0:
            t = np.where((x < lo) | (x > hi), 1.0, 0.0)
        else:
            below, above = np.abs(x - lo) / (4.0 * s), np.abs(x - hi) / (4.0 * s)
            t = np.fmin(np.where(x < lo, below, np.where(x > hi, above, 0.0)), 1.0)
        acc += np.where(none, 1.0, t)
    return np.sqrt(acc, out=acc)


def _route(left: DataFrame, summary: DataFrame, kernel: Kernel, by: list, key: list, k: int,
           blocks: int, split: int, limit: str | None) -> DataFrame:
    """``(by.., key.., _cell)``: the nearest cell of every query, or with ``limit`` (a column)
    all cells within it.  ``blocks`` of queries meet each of ``split`` parts of the summaries, so a group holds
    about QUERY_ROWS queries and SUMMARY_ROWS summaries, however many there are."""
    keys = [F.col(c) for c in key]
    L = left.withColumn("_lb", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    L = L.withColumn("_sb", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
    R = summary.withColumn("_sb", F.pmod(F.xxhash64("_cell"), F.lit(split)).cast("int")).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # fresh attributes: a self search co-groups one lineage with itself
    L, R = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (L, R))
    schema = T.StructType([left.schema[c] for c in [*by, *key]]
                          + [T.StructField("_cell", T.LongType()), T.StructField("_d", T.DoubleType())])
    names = schema.fieldNames()

    def run(group, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        cell, code = np.unique(rpdf["_cell"].to_numpy(), return_inverse=True)
        rows = np.bincount(code, rpdf["_n"].to_numpy())
        full = rows[code] > k                    # cells that can give a k-th distance
        tables: dict = {}
        step, out = max(1, CHUNK_CELLS // len(rpdf)), []
        for at in range(0, len(lpdf), step):
            part = lpdf.iloc[at:at + step]
            d = lower_bounds(kernel, part, rpdf, tables)
            if limit is None:
                if full.any():
                    d[:, ~full] = np.inf
                i, near = np.arange(len(part)), d.argmin(axis=1)
                c, away = code[near], d[np.arange(len(part)), near]
            else:
                i, c = np.nonzero(d <= part[limit].to_numpy(dtype=np.float64)[:, None])
                both = np.unique(i * len(cell) + code[c])
                i, c = both // len(cell), both % len(cell)
                away = np.zeros(len(i))
            found = {n: part[n].to_numpy()[i] for n in [*by, *key]}
            out.append(pd.DataFrame(found | {"_cell": cell[c], "_d": away}, columns=names))
        return pd.concat(out, ignore_index=True)

    found = L.groupBy(*by, "_lb", "_sb").cogroup(R.groupBy(*by, "_lb", "_sb")).applyInPandas(run, schema)
    if limit is None and split > 1:              # the nearest of the parts' nearest cells
        w = Window.partitionBy(*by, *key).orderBy("_d", "_cell")
        found = found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return found.drop("_d")


def bounded_topk(left: DataFrame, right: DataFrame, *, left_key: Sequence[str],
                 right_key: Sequence[str], k: int, kernel: Kernel, attach,
                 eq: Sequence[str] = (), exclude_self: tuple[str, str] | None = None,
                 n_left: int | None = None, n_right: int | None = None,
                 left_payload: dict | None = None, right_payload: dict | None = None,
                 cell_rows: int | None = None) -> DataFrame:
    """The contract of ``blocked_topk``: equality keys are repetitions, folds, or the label of rules."""
    left_key, right_key, by = list(left_key), list(right_key), list(eq)
    ship_package(left.sparkSession)
    n_left = left.count() if n_left is None else n_left
    n_right = right.count() if n_right is None else n_right
    cell_rows = cell_rows or max(CELL_ROWS, math.isqrt(max(1, n_right)))
    options = dict(left_key=left_key, right_key=right_key, k=k, kernel=kernel,
                   exclude_self=exclude_self, left_payload=left_payload,
                   right_payload=right_payload, n_left=n_left, n_right=n_right)
    cells = cells_of(attach(right), kernel, by, right_key, cell_rows, n_right)
    summary = cut_lineage(summaries(cells, kernel, by))
    n_summaries = summary.count()
    if n_summaries * 8 > n_right:                # nearly as many summaries as rows: no gain
        return blocked_topk(left, right, eq=by, attach=attach, **options)
    asked = cut_lineage(attach(left))
    blocks = max(1, math.ceil(n_left / QUERY_ROWS))
    fresh = asked.select(*[F.col(c).alias(c) for c in asked.columns])
    split = max(1, math.ceil(n_summaries / SUMMARY_ROWS))
    home = _route(asked, summary, kernel, by, left_key, k, blocks, split, None)

    def search(queries: DataFrame, pairs: DataFrame, within: str | None = None) -> DataFrame:
        return blocked_topk(queries.join(pairs, [*by, *left_key]), cells, eq=[*by, "_cell"],
                            attach=lambda rows: rows, merge=False, within=within, **options)

    limit = (search(fresh, home).where(F.col("rank") == k).groupBy(*by, *left_key)
             .agg(F.min("distance").alias("_t")))
    limited = cut_lineage(fresh.join(limit, [*by, *left_key], "left").withColumn(
        "_t", F.coalesce("_t", F.lit(float("inf")))))
    pairs = cut_lineage(_route(limited, summary, kernel, by, left_key, k, blocks, split, "_t"))
    w = Window.partitionBy(*by, *left_key).orderBy("distance", *right_key)
    limited = limited.select(*[F.col(c).alias(c) for c in limited.columns])
    return (search(limited, pairs, "_t").drop("_cell").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))
