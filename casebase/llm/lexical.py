"""Ranked lexical search: best-first document intervals bounded by range-maximum tables.

Documents are indexed in blocks.  A block numbers its documents in the order of their keys and has a
posting list (document, occurrences) for every term.  For a set of queries, each posting of their terms has
an impact, what it adds to a document's score, and each posting list a sparse table that tells the
largest impact between any two of its documents.

A query starts with the interval of all documents of a block.  The sum over its terms of the largest
impact within an interval bounds every score there.  The interval with the highest bound comes
first: it's split at the document of its largest single impact, whose score the same lookups give, and both
remaining intervals get their own bounds.  An interval ends once its bound is below the k-th best score,
or equal to it with no smaller key inside.  The k best go on from block to block of a task, so later blocks
start with a high limit.  Nothing is approximate: every document that isn't scored is below its bound.

On Spark: blocks are rows of a written table, each a row group of its own and sent to Python alone, so a task holds
one block (a fixed number of terms; a longer document is a block of its own) however large its file is.  Document
frequencies are one aggregation, of as many terms as the queries have.  A task returns the k best of each query, which a window merges.  Queries are broadcast in sets of at
most ``SET_TERMS`` terms, whatever their number, each searched against all blocks.

Defined cases: NULL and empty texts and texts without terms are no documents, such queries have no
result; very long texts are read in slices; repeated rows are documents (and queries) of their own; NULL keys come last among equal
scores; an empty table gives no row; other columns are ignored.  Keys of documents are 64-bit integers,
keys of queries have any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

BLOCK_TERMS = 1_000_000                    # terms of a block, repeats included
BLOCK_DOCS = 32_768
SLICE = 4 << 20                            # bytes of a text split at once
SET_TERMS, SET_QUERIES = 500_000, 4096     # of queries broadcast at once
AT_ONCE = 64                               # intervals split together
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20    # of texts, and of blocks, that a task sends to Python at once
NO_KEY = 2**63 - 1                         # stands for NULL: last among equals
# a term is a run of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BLOCK = ("n_docs long, n_terms long, keys array<long>, nulls int, sizes array<long>, terms array<binary>, "
         "counts array<int>, docs binary, tfs binary")


def slices(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in slices of bounded size."""
    data = text.encode().translate(TERMS)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.rfind(b" ", at, at + SLICE)
        if end < at:                       # a term longer than a slice
            end = data.find(b" ", at + SLICE)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class _Numbers(dict):
    def __missing__(self, term):
        self[term] = n = len(self)
        return n


def index(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the blocks of ``docs`` to ``folder`` and read them."""
    ship_package(docs.sparkSession)
    _small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, sizes, ids, tfs = _Numbers(), [], [], [], []
        held = 0

        def block() -> pa.RecordBatch:
            order = np.argsort(np.array([NO_KEY if k is None else k for k in keys], np.int64), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            posting = np.concatenate(ids).astype(np.int64) * len(order) \
                + np.repeat(place, [len(x) for x in ids])
            by = np.argsort(posting, kind="stable")
            posting = posting[by]
            first = np.flatnonzero(np.diff(posting, prepend=-1))
            tf = np.add.reduceat(np.concatenate(tfs)[by], first)
            term, doc = np.divmod(posting[first], len(order))
            nulls = sum(k is None for k in keys)
            row = (len(order), sum(sizes), [NO_KEY if keys[i] is None else keys[i] for i in order], nulls,
                   [sizes[i] for i in order], list(number),
                   np.bincount(term, minlength=len(number)).tolist(),
                   doc.astype("<u4").tobytes(), tf.astype("<u4").tobytes())
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()),
                     pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds, strict=True)],
                [c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts, n = [], 0
                for terms in slices(x.as_py() or ""):
                    part = np.fromiter(map(number.__getitem__, terms), np.int32, len(terms))
                    n += len(part)
                    parts.append((part, np.ones(len(part), np.int64)))
                    if len(parts) > 1:     # a very long text: count what has been read
                        seen, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                        parts = [(seen, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64))]
                if not n:
                    continue
                keys.append(k)
                sizes.append(n)
                ids.append(parts[0][0])
                tfs.append(parts[0][1])
                held += len(parts[0][0])
                if held >= BLOCK_TERMS or len(keys) >= BLOCK_DOCS:
                    yield block()
                    number, keys, sizes, ids, tfs = _Numbers(), [], [], [], []
                    held = 0
        if keys:
            yield block()

    (docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_x")).mapInArrow(run, BLOCK)
     .write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(folder))
    return docs.sparkSession.read.schema(BLOCK).parquet(folder)


class Best:
    """The k best (score, key) found, ties to the smaller key."""

    def __init__(self, k: int):
        self.k, self.scores, self.keys, self.nulls = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.score, self.key = 0, -2**63   # of the k-th; a score of 0 is none

    def add(self, scores: np.ndarray, keys: np.ndarray, nulls: np.ndarray) -> None:
        go = (scores > self.score) | ((scores == self.score) & (keys < self.key))
        if not go.any():
            return
        s, q = np.append(self.scores, scores[go]), np.append(self.keys, keys[go])
        x = np.append(self.nulls, nulls[go])
        by = np.lexsort((x, q, -s))[:self.k]
        self.scores, self.keys, self.nulls = s[by], q[by], x[by]
        if len(by) == self.k:
            self.score, self.key = int(s[by[-1]]), int(q[by[-1]])


class Postings:
    """The posting lists of a block's terms, one after the other, with impacts and range-maximum tables."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, nulls: int):
        """``lists``: for each term, document numbers (rising) and impacts."""
        self.keys, self.n = keys, len(keys)
        self.is_null = np.arange(self.n) >= self.n - nulls
        sizes = [len(d) for d, _ in lists]
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        self.docs = np.concatenate([d for d, _ in lists]).astype(np.int64)
        self.impacts = np.concatenate([i for _, i in lists]).astype(np.int64)
        self.places = np.repeat(np.arange(len(lists), dtype=np.int64), sizes) * self.n + self.docs
        most = max(sizes)
        self.log = np.zeros(most + 1, np.int64)
        for i in range(1, most.bit_length()):
            self.log[1 << i:] = i
        # level j: where the largest impact of the 2**j postings from each one on is; a range that leaves its
        # list is never asked for
        self.table = np.empty((most.bit_length(), len(self.docs)), np.int32)
        self.table[0] = np.arange(len(self.docs))
        for j in range(1, len(self.table)):
            right = self.table[j - 1, 1 << (j - 1):]
            self.table[j] = self.table[j - 1]
            left = self.table[j, :len(right)]
            np.copyto(left, right, where=self.impacts[right] > self.impacts[left])

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals x terms of posting ranges: the sum of the terms' largest impacts, and the document
        of the largest one."""
        some = hi > lo
        level = self.log[hi - lo]
        last = len(self.docs) - 1
        a = self.table[level, np.minimum(lo, last)]
        b = self.table[level, np.maximum(hi - (1 << level), 0)]
        x, y = self.impacts[a], self.impacts[b]
        value = np.where(some, np.maximum(x, y), 0)
        row, top = np.arange(len(lo)), value.argmax(axis=1)
        where = np.where(x[row, top] >= y[row, top], a[row, top], b[row, top])
        return value.sum(axis=1), self.docs[where]

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Put the best documents for the block's ``terms`` into ``best``; returns how many were scored."""
        lo, hi = self.starts[terms][None, :], self.ends[terms][None, :]
        base, first, scored = terms * self.n, np.zeros(1, np.int64), 0
        bound, split = self.bounds(lo, hi)
        while True:
            go = (bound > best.score) | ((bound == best.score) & (self.keys[first] < best.key))
            if not go.all():
                bound, split, first, lo, hi = bound[go], split[go], first[go], lo[go], hi[go]
            if not len(bound):
                return scored
            now = np.argsort(-bound, kind="stable")
            now, later = now[:AT_ONCE], now[AT_ONCE:]
            doc, l, h = split[now], lo[now], hi[now]
            at = np.searchsorted(self.places, base + doc[:, None])
            there = np.minimum(at, len(self.places) - 1)
            hit = self.places[there] == base + doc[:, None]
            scored += len(doc)
            best.add(np.where(hit, self.impacts[there], 0).sum(axis=1), self.keys[doc], self.is_null[doc])
            lo2, hi2 = np.concatenate([l, at + hit]), np.concatenate([at, h])
            first2 = np.concatenate([first[now], np.minimum(doc + 1, self.n - 1)])
            bound2, split2 = self.bounds(lo2, hi2)
            ok = bound2 > 0
            bound, split = np.append(bound[later], bound2[ok]), np.append(split[later], split2[ok])
            first = np.append(first[later], first2[ok])
            lo, hi = np.concatenate([lo[later], lo2[ok]]), np.concatenate([hi[later], hi2[ok]])


def _impacts(weight: int, doc: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))


def _length_norm(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """``100 - 90 + (90 * size * n) div total``."""
    if int(sizes.max(initial=0)) * 90 * n >= 2**63:
        sizes = sizes.astype(object)
    return (10 + (90 * sizes * n) // total).astype(np.int64)


def _sets(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """``(key, distinct terms)`` of the queries, in sets of bounded size."""
    held, size = [], 0
    for r in queries.select(F.col(key).alias("_k"), F.col(text).alias("_x")).toLocalIterator():
        terms = sorted({t for part in slices(r._x or "") for t in part})
        if terms:
            held.append((r._k, terms))
            size += len(terms)
        if size >= SET_TERMS or len(held) >= SET_QUERIES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(blocks: DataFrame, queries: DataFrame, k: int = 10, *, query_key: str = "item_id",
           text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(query_key, rank, key, score)``: the k best documents of ``blocks`` (of :func:`index`) for each query."""
    spark = blocks.sparkSession
    ship_package(spark)
    _small_batches(spark)
    kind = queries.schema[query_key].dataType.simpleString()
    schema = f"`{query_key}` {kind}, rank int, `{key}` long, score long"
    sums = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).head()
    out = None
    for asked in _sets(queries, query_key, text) if sums.n else ():
        weights = (_frequencies(blocks, {t for _, ts in asked for t in ts}).groupBy("term").agg(F.sum("n").alias("df"))
                   .select("term", F.floor(1000 * F.log((2 * F.lit(sums.n) + 2) / (2 * F.col("df") + 1)))
                           .alias("w")))
        found = _searched(blocks, [ts for _, ts in asked], {bytes(r.term): r.w for r in weights.collect()},
                          sums.n, sums.l, k)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], f"query int, item {kind}")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
            .join(F.broadcast(names), "query") \
            .select(F.col("item").alias(query_key), "rank", F.col("doc").alias(key), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], schema) if out is None else out


def _frequencies(blocks: DataFrame, vocabulary: set[bytes]) -> DataFrame:
    """``(term, n)``: how many documents of each block have a term of ``vocabulary``."""
    sent = blocks.sparkSession.sparkContext.broadcast(sorted(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.binary())
        for b in batches:
            terms, n = (b.column(i).flatten() for i in (0, 1))
            here = pc.is_in(terms, value_set=known)
            yield pa.RecordBatch.from_arrays([terms.filter(here), n.filter(here)], ["term", "n"])

    return blocks.select("terms", "counts").mapInArrow(run, "term binary, n int")


def _searched(blocks: DataFrame, asked: list[list[bytes]], weights: dict[bytes, int], n: int, total: int,
              k: int) -> DataFrame:
    """``(query, doc, score)``: at least the k best of each query, from the blocks of each task."""
    sent = blocks.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = sent.value
        known = pa.array([t for t, w in weights.items() if w], pa.binary())
        best = [Best(k) for _ in asked]
        for batch in batches:
            for b in (batch.slice(i, 1) for i in range(len(batch))):
                keys, sizes = (np.asarray(b.column(i).flatten()) for i in (0, 2))
                m = _length_norm(sizes, n, total)
                counts = np.asarray(b.column(4).flatten())
                doc, tf = (np.frombuffer(b.column(i)[0].as_buffer(), "<u4") for i in (5, 6))
                ends, terms = np.cumsum(counts), b.column(3).flatten()
                at = np.flatnonzero(pc.is_in(terms, value_set=known).to_numpy(zero_copy_only=False))
                here, lists = {}, []
                for t, e, c in zip(terms.take(pa.array(at)).to_pylist(), ends[at].tolist(), counts[at].tolist(),
                                   strict=True):
                    here[t] = len(lists)
                    lists.append((doc[e - c:e], _impacts(weights[t], doc[e - c:e], tf[e - c:e].astype(np.int64), m)))
                if not lists:
                    continue
                postings = Postings(lists, keys, b.column(1)[0].as_py())
                for terms, found in zip(asked, best, strict=True):
                    ranks = np.array([here[t] for t in terms if t in here], np.int64)
                    if len(ranks):
                        postings.search(ranks, found)
        cols = [np.repeat(np.arange(len(best)), [len(x.scores) for x in best]),
                *(np.concatenate([getattr(x, c) for x in best]) for c in ("keys", "scores", "nulls"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64(), mask=cols[3]),
             pa.array(cols[2], pa.int64())], ["query", "doc", "score"])

    return blocks.select("keys", "nulls", "sizes", "terms", "counts", "docs", "tfs") \
        .mapInArrow(run, "query int, doc long, score long")
