"""Small helpers of the operators in this package."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def release() -> None:
    """Give memory that this worker no longer uses back to the machine: workers outlive their tasks, and
    what one stage held would stand beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


_STATE: dict = {}


def worker_state(owner, make=dict):
    """What a worker keeps for ``owner`` between tasks, made when first asked for.  A worker keeps the state of
    one owner: another operator's task drops it, so stages don't add up in memory."""
    if owner not in _STATE:
        _STATE.clear()
        release()
        _STATE[owner] = make()
    return _STATE[owner]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """All of ``rows`` if they are at most ``bound``, else about ``bound`` of them by
    key hash: the documented sample of a fit.  If few keys hold most rows, so that the
    hash keeps more than twice as many, those are thinned out at random (with a seed)."""
    n = rows.count()
    if n <= bound:
        return rows
    cut = max(1, int(2**31 * bound / n))
    part = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(2**31)) < cut)
    m = part.count()
    return part if m <= 2 * bound else part.where(F.rand(7) < bound / m)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked with every index 0..n-1 by the links (a, b), vectorised."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:                              # point at the root
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label


def connected(edges: DataFrame, cut) -> DataFrame:
    """``(v, label)`` for every vertex of ``edges(u, v)``: the smallest vertex reachable.

    Labels spread over the edges and then jump to the label of their label.
    Every round is one aggregation and two joins; ``cut`` writes its result to
    the shared folder.  Only the number of changed labels reaches the driver.
    """
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"),
                                                         F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"))
                 .select(F.col("u").alias("v"), "label"))
    while True:
        near = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("label").alias("m"))
        low = labels.join(near, "v", "left").select(
            "v", F.least("label", F.coalesce("m", "label")).alias("label"),
            F.col("label").alias("old"))
        roots = low.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = cut(low.join(roots, "label", "left")
                  .select("v", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        if new.where("label <> old").limit(1).count() == 0:
            return new.select("v", "label")
        labels = new.select("v", "label")
