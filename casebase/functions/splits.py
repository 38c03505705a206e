"""Deterministic splits by a digest of the case key.

The reference draws unseeded random 70/30 splits.  Here a split is a pure
function of ``(id, rep)`` so it is reproducible, needs no shuffle, survives
task retries unchanged, and can be written in any SQL dialect::

    digest(id, tag) = first 8 hex digits of md5(id || ':' || tag), as a number

``train`` is ``digest(id, rep) % 1000 < 1000 * fraction``; a fold is
``digest(id, 'fold' || seed) % k``.  Any key works (no arithmetic on it can overflow,
and patterns such as multiples of 1000 do not matter); a NULL key counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1000                            # fixed value of the split rule


def _digest(id_col: str | Column, tag: Column) -> Column:
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.concat(F.coalesce(idc.cast("string"), F.lit("")), F.lit(":"), tag.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def bucket(id_col: str | Column, rep: int | str | Column = 0) -> Column:
    if isinstance(rep, str):
        rc = F.col(rep)
    elif isinstance(rep, Column):
        rc = rep
    else:
        rc = F.lit(int(rep))
    return _digest(id_col, rc) % F.lit(BUCKETS)


def is_train(id_col: str | Column, rep: int | str | Column = 0, fraction: float = 0.7) -> Column:
    return bucket(id_col, rep) < F.lit(int(round(BUCKETS * fraction)))


def fold(id_col: str | Column, k: int, seed: int = 0) -> Column:
    return (_digest(id_col, F.lit(f"fold{seed}")) % F.lit(k)).cast("int")


def _sql_digest(id_expr: str, tag: str) -> str:
    text = f"coalesce(CAST({id_expr} AS VARCHAR), '') || ':' || {tag}"
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def sql_bucket(id_expr: str, rep: int | str = 0) -> str:
    """The same rule as SQL text."""
    return f"{_sql_digest(id_expr, f'CAST({rep} AS VARCHAR)')} % {BUCKETS}"


def sql_is_train(id_expr: str, rep: int | str = 0, fraction: float = 0.7) -> str:
    return f"{sql_bucket(id_expr, rep)} < {int(round(BUCKETS * fraction))}"


def sql_fold(id_expr: str, k: int | str, seed: int = 0) -> str:
    return f"CAST({_sql_digest(id_expr, repr(f'fold{seed}'))} % {k} AS INTEGER)"
