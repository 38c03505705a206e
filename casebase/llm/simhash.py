"""SimHash near-duplicates: fingerprints, binary-trie self-join, components.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, word shingles with
repeats; a bit is set if it is set in over half of the shingles' XXH64 hashes.

Search: a binary trie over the *distinct* fingerprints is joined with itself.
Pairs of nodes go down together, add up the bits in which they differ, and are
dropped as soon as the sum is over ``max_bits``.  Of two fingerprints that
differ in at most ``m`` bits, one of ``m + 1`` blocks of bits is equal, so the
trie is walked once for every block put first, with an error budget of 0 in
that block and of ``m`` below it.  The pairs of nodes that are left after the
first block are (prefix, prefix): Spark deals the fingerprints to tasks by that
prefix, ``m + 1`` rows each.  A prefix with more than ``unit_rows``
fingerprints is walked some levels further by Spark, and its pairs of sub-nodes
within the budget become units of their own, so no hot prefix stays in one task.
A unit's links leave as a spanning forest (a link to the unit's smallest
fingerprint), never as all pairs; components are found by joins.

Defined cases: NULL or empty text has no words and fingerprint 0, which links
like any other; fewer words than a shingle make one shingle of all; repeated
rows are repeated in the result; a NULL key never is a component's name unless
all keys of it are NULL; an empty table gives an empty result; further columns
of the input are ignored.  Very long texts are hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .common import components, connected, release, worker_state

SEED = 42
SLICE = 65_536               # words hashed at once
FRONT = 1_000_000            # pairs of nodes that go down together
UNIT_ROWS_HELD = 50_000      # rows of units that a task joins together


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()   # bytes: A-Z, 0x20 and 0x09-0x0D only
    if not words:
        return 0
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0
    for at in range(0, max(1, len(words) - shingle + 1), SLICE):
        part = words[at:at + SLICE + shingle - 1]
        if len(part) <= shingle:
            joined = [b" ".join(part)]
        else:
            joined = map(b" ".join, zip(*[part[i:] for i in range(shingle)], strict=False))
        h = np.array([digest(x, SEED) for x in joined], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 shingle: int = 3) -> DataFrame:
    """``(key, fp long)``: the fingerprint's bits as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)),
                             dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))],
                                             ["_k", "fp"])
        release()

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("_k"), F.col(text).alias("_x"))
            .mapInArrow(run, f"_k {kind}, fp long").toDF(key, "fp"))


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the ``max_bits + 1`` blocks."""
    n = max_bits + 1
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def walk(fp: np.ndarray, starts: np.ndarray, depth: int,
         max_bits: int) -> np.ndarray:
    """Join tries with themselves: label of every index, equal if linked.

    ``fp`` (uint64, sorted inside every node) holds the fingerprints with the
    node's bits first; ``starts`` are pairs of nodes ``(a, a_end, b, b_end)``, whose
    first ``depth`` bits cost nothing.
    """
    label = np.arange(len(fp))
    front = starts.astype(np.int64).reshape(-1, 4)
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, front, np.zeros(len(front), dtype=np.int8))]
    while stack:
        d, front, diff = stack.pop()
        if len(front) > FRONT:                    # depth first beyond that
            half = len(front) // 2
            stack += [(d, front[half:], diff[half:]), (d, front[:half], diff[:half])]
            continue
        a, a_end, b, b_end = front.T
        same = a == b
        # two leaves: the remaining bits at once
        leaf = (a_end - a == 1) & (b_end - b == 1)
        if leaf.any():
            i, j = a[leaf & ~same], b[leaf & ~same]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            if near.any():
                label = components(len(fp), label[i[near]], label[j[near]])[label]
            front, diff, same = front[~leaf], diff[~leaf], same[~leaf]
            a, a_end, b, b_end = front.T
        if not len(front) or d == 64:
            if len(front):                        # repeated fingerprints
                label = components(len(fp), label[a], label[b])[label]
            continue
        if d not in ones:
            bit = (fp >> np.uint64(63 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        am = a_end - (ones[d][a_end] - ones[d][a])     # where the ones begin
        bm = b_end - (ones[d][b_end] - ones[d][b])
        kids = [(a, am, b, bm, diff, True), (am, a_end, bm, b_end, diff, True),
                (a, am, bm, b_end, diff + 1, True), (am, a_end, b, bm, diff + 1, ~same)]
        rows, bits = [], []
        for x, x_end, y, y_end, e, ok in kids:
            keep = ok & (x < x_end) & (y < y_end) & (e <= max_bits)
            keep &= (x != y) | (x_end - x > 1)
            rows.append(np.stack([x[keep], x_end[keep], y[keep], y_end[keep]], axis=1))
            bits.append(e[keep])
        stack.append((d + 1, np.concatenate(rows), np.concatenate(bits).astype(np.int8)))
    return label


def links(distinct: DataFrame, max_bits: int, unit_rows: int = 4096) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints ``fp`` whose components are those
    of all links of at most ``max_bits`` differing bits (a forest in every unit)."""
    ship_package(distinct.sparkSession)
    parts = blocks(max_bits)
    turned = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("turn"), F.lit(a).alias("by"), F.lit(w).alias("width"))
        for i, (a, w) in enumerate(parts)])).alias("t")).select("fp", "t.*")
    turned = turned.select(
        "fp", "turn", "width",
        F.expr("CASE WHEN `by` = 0 THEN fp ELSE "
               "shiftleft(fp, `by`) | shiftrightunsigned(fp, 64 - `by`) END").alias("x"))
    turned = turned.withColumn("prefix", F.expr("shiftrightunsigned(x, 64 - width)"))
    # at most 2^width prefixes a turn, and one for unit_rows fingerprints
    hot = (turned.groupBy("turn", "prefix").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > unit_rows)
           .withColumn("deep", F.least(F.lit(16), F.ceil(F.log2(F.col("n") / unit_rows)).cast("int")))
           .drop("n"))
    turned = turned.join(hot, ["turn", "prefix"], "left")
    cold = turned.where("deep IS NULL").withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    ext = "cast(shiftrightunsigned(shiftleft(x, width), 64 - deep) AS int)"
    split = (turned.where("deep IS NOT NULL").withColumn("e", F.expr(ext))
             .withColumn("other", F.explode(F.expr(
                 f"transform(filter(sequence(0, shiftleft(1, deep) - 1), "
                 f"m -> bit_count(m) <= {max_bits}), m -> m ^ e)")))
             .withColumns({"lo": F.least("e", "other"), "hi": F.greatest("e", "other"),
                           "side": (F.col("e") > F.col("other")).cast("int")}))
    cols = ["turn", "prefix", "lo", "hi", "side", "x", "fp", "width"]
    units = cold.withColumn("side", F.lit(0)).select(cols).unionByName(split.select(cols))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(n, "turn", "prefix", "lo", "hi").sortWithinPartitions(
        "turn", "prefix", "lo", "hi", "side", F.expr("x ^ shiftleft(1L, 63)"))

    def join_units(rows: list[np.ndarray]) -> pa.RecordBatch:
        turn, prefix, lo, hi, side, x, fp, width = rows
        cut = _changes(turn, prefix, lo, hi)
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])
        ones = np.concatenate([[0], np.cumsum(side)])
        middle = end - (ones[end] - ones[begin])          # the second sub-node begins
        own = lo[begin] == hi[begin]
        starts = np.stack([begin, np.where(own, end, middle),
                           np.where(own, begin, middle), end], axis=1)
        starts = starts[(starts[:, 0] < starts[:, 1]) & (starts[:, 2] < starts[:, 3])]
        us, vs = [], []
        for w in np.unique(width):
            label = walk(x.view(np.uint64), starts[width[starts[:, 0]] == w], int(w), max_bits)
            i = np.flatnonzero(label != np.arange(len(label)))
            us.append(fp[i])
            vs.append(fp[label[i]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)),
                                           pa.array(np.concatenate(vs))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []                 # whole units, and one that goes on
        size = 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size < UNIT_ROWS_HELD:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = _changes(*rows[:4])
            if len(cut):
                yield join_units([c[:cut[-1]] for c in rows])
                rows = [c[cut[-1]:] for c in rows]
            held, size = [rows], 0
        if held:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            if len(rows[0]):
                yield join_units(rows)

    return units.mapInArrow(run, "u long, v long")


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    return np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1


def component_names(prints: DataFrame, key: str, max_bits: int, unit_rows: int) -> DataFrame:
    """``(fp, component_id, lead)`` of the distinct fingerprints of ``prints(key, fp)``:
    the smallest key of the component, and the fingerprint that has it (the smallest such)."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("low")))
    label = connected(links(distinct.select("fp"), max_bits, unit_rows), cut_lineage)
    named = distinct.join(label.withColumnRenamed("v", "fp"), "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"),
        F.struct(F.col("low").isNull().alias("none"), "low", "fp").alias("first"))
    names = named.groupBy("label").agg(F.min("first").alias("first"))
    return named.drop("first").join(names, "label").select(
        "fp", F.col("first.low").alias("component_id"), F.col("first.fp").alias("lead"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    shingle: int = 3, max_bits: int = 3, unit_rows: int = 4096) -> DataFrame:
    """``(key, fp, component_id)`` for every row; ``component_id`` is the smallest key
    of the rows reachable by links of at most ``max_bits`` differing bits."""
    prints = cut_lineage(fingerprints(docs, key=key, text=text, shingle=shingle))
    names = component_names(prints, key, max_bits, unit_rows)
    return prints.join(names, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3,
                max_bits: int = 3, unit_rows: int = 4096) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key; of rows that
    repeat it, or if no row of the component has a key, the first by the text's digest."""
    own = cut_lineage(fingerprints(docs.select(
        F.struct(F.col(key).alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("t"),
                 F.col(text).isNull().alias("n")).alias("row"), text),
        key="row", text=text, shingle=shingle))
    names = component_names(own.select(F.col("row.k").alias("k"), "fp"), "k", max_bits, unit_rows)
    leads = names.where("fp = lead").select("fp", "component_id")
    alike = own.groupBy("row", "fp").agg(F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(alike.join(leads, "fp")
                       .where(F.col("row.k").eqNullSafe(F.col("component_id")))
                       .groupBy("fp").agg(F.min(F.struct("row", "n")).alias("first"))
                       .select("first.row.*", F.col("first.n").alias("rows")))
    mark = [F.col(key).alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("t"),
            F.col(text).isNull().alias("n")]
    marked = docs.select(F.struct(*docs.columns).alias("doc"), *mark)

    def of(wanted: DataFrame) -> DataFrame:
        on = [marked[c].eqNullSafe(wanted[c]) for c in ("k", "t", "n")]
        return marked.join(wanted, on, "left_semi")

    found = of(kept).select("doc.*")
    if kept.where("rows > 1").limit(1).count():          # rows that agree in key and text
        found = of(kept.where("rows = 1")).select("doc.*").union(
            of(kept.where("rows > 1")).groupBy("k", "t", "n").agg(F.min("doc").alias("doc"))
            .select("doc.*"))
    return found
