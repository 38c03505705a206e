"""Proportional stratified interleaving into shards, by DataFrame functions only.

Rows are shuffled by a seeded hash within each source and ranked; the fractional
rank ``(rank - 1/2) / rows of the source`` sorts all rows so that every stretch of the
order holds the sources in proportion; equal cuts of the order are the shards.

No window holds a whole source or table: ranks are counted within (source, hash
bucket), positions within the ranges of a distributed sort by fractional rank and hash, and the sums of
the counts that come before (tables of at most ``buckets`` rows a source, and a row a
range) are added.  Sources of equal size have equal fractions; their hashes split them into ranges.  Only row keys, hashes and numbers are shuffled, not texts.

Defined cases: a NULL source is a source of its own; a NULL text has no bytes (size
1, crc32 0); NULL keys are hashed as such; rows with the same key, bytes and checksum
share a hash and are told apart by their count alone, so the result is the same for any
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HEX = 3                                   # hex digits of the hash that name a bucket
BUCKETS = 16 ** HEX


def interleave(docs: DataFrame, shards: int, *, key: str = "doc_id", source: str = "source",
               text: str = "text", seed: int = 17) -> DataFrame:
    """``(key, source, size, text_crc32, position, shard, slot)`` of every row."""
    if shards < 1:
        raise ValueError("shards must be >= 1")
    body = F.coalesce(F.col(text), F.lit(""))
    size, crc = F.octet_length(body).cast("long") + 1, F.crc32(body.cast("binary"))
    rows = cut_lineage(docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), size.alias("size"),
        crc.alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), size,
                          crc).cast("binary")).alias("h"))
        .withColumn("bucket", F.conv(F.substring("h", 1, HEX), 16, 10).cast("int")))
    order = ["h", "_key", "text_crc32", "size"]

    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = (rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("stratum", "bucket",
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                      F.sum("n").over(Window.partitionBy("stratum")).alias("total")))
    inside = Window.partitionBy("stratum", "bucket").orderBy(*order)
    ranked = (rows.withColumn("i", F.row_number().over(inside))
              .join(counts, ["stratum", "bucket"])
              .withColumn("fraction", (2 * (F.col("before") + F.col("i")) - 1).cast("double")
                          / (2 * F.col("total")).cast("double"))
              .drop("i", "before", "total", "bucket"))
    # sorted in ranges of (fraction, hash, ..): rows with equal fractions fall into many ranges
    ordered = cut_lineage(ranked.orderBy("fraction", "h", "stratum", *order[1:])
                          .withColumn("at", F.monotonically_increasing_id())
                          .withColumn("part", F.shiftright("at", 33))
                          .withColumn("at", F.col("at") - F.shiftleft("part", 33)))

    sums = (ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))          # a row a range
            .select("part", F.coalesce(F.sum("n").over(
                Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0)).alias("before"),
                F.sum("n").over(Window.partitionBy()).alias("total")))
    placed = (ordered.join(F.broadcast(sums), "part")
              .withColumn("position", F.col("before") + F.col("at"))
              .withColumn("shard", F.expr(f"position * {shards} div total").cast("int"))
              .withColumn("slot", F.expr(
                  f"position - (shard * total + {shards} - 1) div {shards}")))
    return placed.select(F.col("_key").alias(key), F.col("_source").alias(source), "size",
                         "text_crc32", "position", "shard", "slot")
