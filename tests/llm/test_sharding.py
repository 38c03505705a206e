"""Stratified interleaving: against a plain version, mixture, odd rows, plan."""

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from casebase.llm import sharding as S


def plain(rows, shards, seed=17):
    """(key, size, crc, shard, slot) by sorting everything."""
    by = {}
    for key, text, source in rows:
        raw = (text or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        h = hashlib.md5(f"{seed}:{'' if key is None else key}:{size}:{crc}".encode()).hexdigest()
        stratum = "" if source is None else "=" + source
        by.setdefault(stratum, []).append((h, (key is not None, key or 0), crc, size, key, stratum))
    every = []
    for group in by.values():
        group.sort(key=lambda r: r[:4])
        every += [((2 * i + 1) / (2 * len(group)), r[0], r[5], r[1], r[2], r[3], r[4]) for i, r in enumerate(group)]
    every.sort(key=lambda r: r[:6])
    n, out = len(every), []
    for p, (_, _, _, _, crc, size, key) in enumerate(every):
        shard = p * shards // n
        out.append((key, size, crc, shard, p - -(-shard * n // shards)))
    return sorted(out, key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, source string, h string")


def _rows():
    rows = [(i, "té" * (i % 13), "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    return rows + [(None, None, None), (None, None, None), (5, None, "s1"), (7, "x" * 50_000, ""), (7, "a", "b"), (7, "a", "b")]


def test_like_plain_version(spark):
    rows = _rows()
    for shards in (1, 3, 8, 500):
        got = sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot)
                      for r in S.interleave(_frame(spark, rows), shards).collect()), key=str)
        assert got == plain(rows, shards)


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 5}") for i in range(2000)]
    got = S.interleave(_frame(spark, rows), 8).collect()
    total, each = Counter(s for _, _, s in rows), Counter((r.shard, r.source) for r in got)
    assert {n for n in Counter(r.shard for r in got).values()} == {250}
    for s, n in total.items():
        # a cut by position is off a cut by fraction by at most half a row a source
        assert all(abs(each[k, s] - n / 8) <= 1 + len(total) * n / len(rows) for k in range(8))


def test_partitions_do_not_matter(spark):
    df = _frame(spark, _rows())
    one = {tuple(r) for r in S.interleave(df.coalesce(1), 4).collect()}
    assert one == {tuple(r) for r in S.interleave(df.repartition(9), 4).collect()}


def test_no_python_and_no_rows(spark):
    df = S.interleave(_frame(spark, _rows()), 4)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
    assert S.interleave(_frame(spark, _rows()).where(F.lit(False)), 4).count() == 0


def test_many_sources_of_one_row(spark):
    """Their fractions are all one half: the ranges of the sort split them by hash."""
    rows = [(i, "t", f"only{i}" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = S.interleave(_frame(spark, rows), 8)
        got = sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()), key=str)
        most = max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == plain(rows, 8)
    assert most < 1000
