"""Majority vote with a total tie rule (C1).  NULL does not vote; without votes it wins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

GRID_ROWS = 200_000          # chosen rules that are voted on together, about


def vote(df: DataFrame, keys: Sequence[str], value: str, out: str = "prediction") -> DataFrame:
    """Most frequent ``value`` per ``keys``; ties go to the smallest value.

    Groups are the votes of one query (at most k or rno rows), so the window
    never holds more than a handful of rows per key.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_votes"))
    w = Window.partitionBy(*keys).orderBy(F.col("_votes").desc(), F.col(value).asc())
    return (counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(*keys, F.col(value).alias(out)))


def vote_bounded(df: DataFrame, keys: Sequence[str], value: str,
                 out: str = "prediction") -> DataFrame:
    """C1 for groups of known small size (k neighbours, rno rules).

    One aggregation: the group's values (at most k, by construction) are
    collected, and the most frequent, smallest value is picked with array
    functions inside the aggregate's projection.  Input already partitioned
    by ``keys`` (as after the neighbour search) needs no further shuffle.
    """
    keys = list(keys)
    vals = F.collect_list(value)
    pick = F.try_element_at(F.array_sort(F.transform(
        F.array_distinct(F.col("_v")),
        lambda v: F.struct((-F.size(F.filter(F.col("_v"), lambda x: x == v))).alias("n"),
                           v.alias("v")))), F.lit(1)).getField("v")
    return df.groupBy(*keys).agg(vals.alias("_v")).select(*keys, pick.alias(out))


def _winners(group: np.ndarray, value: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups, and the most frequent value (ties: smallest) of each."""
    pairs, n = np.unique(group * values + value, return_counts=True)
    g, v = pairs // values, pairs % values
    order = np.lexsort((v, -n, g))
    groups, first = np.unique(g[order], return_index=True)
    return groups, v[order][first]


def grid_right(chosen: DataFrame, by: Sequence[str], ks: Sequence[int], rnos: Sequence[int], n_rows: int) -> DataFrame:
    """C3 at every grid point: ``(by.., k, rno, right)``, the queries whose vote is their label.

    ``chosen`` holds the rules of every (query, base): ``query_id, label, base_id, base_rank, rule_rank, to_label``, about
    ``n_rows`` in all.  A query's rules are brought together once and voted on under every pair of rank limits; they
    are not copied for the grid points.
    """
    by = list(by)
    ship_package(chosen.sparkSession)
    buckets = max(1, -(-n_rows // GRID_ROWS))
    ids = ["query_id", "base_id"]
    # NULL is no label and does not vote; a NULL id is an id of its own
    rows = chosen.where(F.col("label").isNotNull() & F.col("to_label").isNotNull()).select(
        F.pmod(F.xxhash64(*by, "query_id"), F.lit(buckets)).alias("_b"), *by, "label", "to_label", "base_rank",
        "rule_rank", *[F.col(c).isNull().alias(f"_no_{c}") for c in ids],
        *[F.coalesce(c, F.lit(0).cast(chosen.schema[c].dataType)).alias(c) for c in ids])
    fields = ", ".join(f"`{b}` {chosen.schema[b].dataType.simpleString()}" for b in by)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [*by, "query_id", "_no_query_id", "label"]
        q = pdf.groupby(asked, sort=False).ngroup().to_numpy()
        base = pd.DataFrame({"q": q, "id": pdf["base_id"], "no": pdf["_no_base_id"]}).groupby(
            ["q", "id", "no"], sort=False).ngroup().to_numpy()
        classes = sorted(set(pdf["label"]) | set(pdf["to_label"]))
        code = {c: i for i, c in enumerate(classes)}
        to, label = (pdf[c].map(code).to_numpy() for c in ("to_label", "label"))
        _, first = np.unique(q, return_index=True)
        own, of = label[first], np.zeros(base.max() + 1, dtype=np.int64)
        of[base] = q
        at, rank = pdf["base_rank"].to_numpy(), pdf["rule_rank"].to_numpy()
        keys, out = pdf[by].iloc[first], []
        for k in sorted(set(ks)):
            for rno in sorted(set(rnos)):
                some = (at <= k) & (rank <= rno)
                bases, target = _winners(base[some], to[some], len(classes))
                queries, voted = _winners(of[bases], target, len(classes))
                right = keys.iloc[queries[voted == own[queries]]]
                if len(right):
                    out.append(right.groupby(by, sort=False).size().rename("right").reset_index().assign(k=k, rno=rno))
        names = [*by, "k", "rno", "right"]
        return pd.concat(out)[names] if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in names})

    return (rows.groupBy("_b").applyInPandas(count, f"{fields}, k int, rno int, right long")
            .groupBy(*by, "k", "rno").agg(F.sum("right").alias("right")))
