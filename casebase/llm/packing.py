"""Packing of documents into training sequences by best-fit decreasing.

Every document becomes token ids and an end id.  Overlong documents are first cut into full
windows; the pieces left, longest first, each go to the open window with the least remaining
capacity that still holds them.  A segment tree over the remaining capacities finds it.

Best-fit decreasing sees of a piece only its length, and equal lengths come one after the
other.  So the pieces are counted by length (at most ``length`` numbers reach the driver, however
many documents there are), and the packing is done on the counts: as many windows of one
remaining capacity as a length fills up take their pieces in one step, which gives exactly what
one piece after the other would.  The steps say which ranks of a length go to which windows.
A step leaves a window less than half of its remaining capacity, and a length splits at most
three ranges of windows, so there are at most ``3 * length * log2(length)`` steps: that is what is broadcast.

On Spark: pieces are written once, with their task and their number among the task's
pieces of the same length; the counts of the tasks before are added for the rank within
the length; and the rank is joined to its step.  A length held by a third of all pieces is numbered in
the tasks that cut them and looked up by broadcast, so it lands in no single task.

Defined cases: NULL and empty texts are documents of the end id alone; very long texts are cut as
any other; repeated rows and NULL keys are documents of their own; an empty table has no
piece; other columns are ignored.  Keys have any type.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

HELD = 8 << 20                             # bytes of ids in a batch that a task returns
JOINED = 100_000                           # (task, length) counts up to which they are broadcast
STEP = "length int, first long, n long, each long, window long, at int"


class Capacities:
    """Segment tree over the remaining capacities 0..most: how many windows have each."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, n: int) -> None:
        i = self.base + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that a window has."""
        i = self.base + need
        if self.count[i]:
            return need
        while i > 1 and (i & 1 or not self.count[i + 1]):            # up, until something is to the right
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.base:                                          # down, to its leftmost leaf
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.base


def best_fit_decreasing(counts: dict[int, int], length: int) -> tuple[list[tuple], int]:
    """Steps ``(length, first rank, pieces, pieces a window, first window, offset)`` and the number
    of windows, for ``counts`` pieces of each length."""
    tree, ranges = Capacities(length), {}      # ranges: remaining capacity -> [(first window, windows)]
    steps, windows = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            ranges.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            capacity = tree.tightest(size)
            if capacity is None:               # nothing open holds it: new windows
                capacity, first, n = length, windows, -(-left // (length // size))
                windows += n
            else:
                first, n = ranges[capacity].pop()
                tree.add(capacity, -n)
            each = min(capacity // size, left)
            full = min(n, left // each)
            steps.append((size, rank, full * each, each, first, length - capacity))
            put(capacity - each * size, first, full)
            rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:                     # the last window takes the rest
                steps.append((size, rank, left, left, first + full, length - capacity))
                put(capacity - left * size, first + full, 1)
                full, left = full + 1, 0
            put(capacity, first + full, n - full)
    return steps, windows


def cut(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], folder: str, *,
        length: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the pieces of ``docs`` to ``folder`` and read them: ``(key, start, length, doc_tokens,
    ids, task, number)``; ids are little-endian unsigned 32-bit integers.

    ``encoder()`` is called in every task and returns the function from texts to their ids as bytes.
    """
    ship_package(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(), TaskContext.get().partitionId(), Counter()
        for b in batches:
            held, rows, cols = 0, [], [[] for _ in kinds]

            def made(b=b):
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int32())), *map(pa.array, cols, kinds)],
                    [key, "start", "length", "doc_tokens", "ids", "task", "number"])
            for at in range(0, len(b), 256):
                for i, ids in enumerate(encode([x or "" for x in b.column(1).slice(at, 256).to_pylist()]), at):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        rows.append(i)
                        row = (start, size, n, ids[4 * start:4 * (start + size)], task, seen[size])
                        for col, x in zip(cols, row, strict=True):
                            col.append(x)
                        seen[size] += 1
                    held += len(ids)
                    if held >= HELD:
                        yield made()
                        held, rows, cols = 0, [], [[] for _ in kinds]
            if rows:
                yield made()

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)]).add("start", "long").add("length", "integer") \
        .add("doc_tokens", "long").add("ids", "binary").add("task", "integer").add("number", "long")
    (docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
     .write.option("compression", "zstd").parquet(folder))
    return docs.sparkSession.read.parquet(folder)


def pack(pieces: DataFrame, length: int) -> DataFrame:
    """``pieces`` (of :func:`cut`) with ``sequence_id`` and ``offset``, each gapless from 0."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    found = counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).collect()
    totals = {r.length: r.n for r in found}                           # at most ``length`` numbers
    steps, _ = best_fit_decreasing(totals, length)

    # a length's ranks are cut into as many equal stretches as it has steps, and a step is listed
    # under each stretch that it meets: a piece compares a few steps, whatever their sizes
    many = Counter(s[0] for s in steps)
    width = {size: -(-totals[size] // many[size]) for size in totals}
    listed = [(*s, b) for s in steps
              for b in range(s[1] // width[s[0]], (s[1] + s[2] - 1) // width[s[0]] + 1)]
    plan = spark.createDataFrame(listed, f"{STEP}, stretch long")
    widths = spark.createDataFrame(list(width.items()), "length int, width long")

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")) \
        .join(F.broadcast(widths), "length")
    if sum(r.tasks for r in found) <= JOINED:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("number"))
    of = ranked["rank"] - plan["first"]
    return ranked.join(F.broadcast(plan), (ranked.length == plan.length)
                       & (F.expr("rank div width") == plan.stretch)
                       & (of >= 0) & (of < plan["n"])) \
        .select(*(ranked[c] for c in pieces.columns if c not in ("task", "number")),
                (plan["window"] + F.floor(of / plan["each"])).alias("sequence_id"),
                (plan["at"] + F.pmod(of, plan["each"]) * ranked.length).cast("long").alias("offset"))


def sequences(packed: DataFrame, length: int, pad_id: int) -> DataFrame:
    """``(sequence_id, tokens, ids)``: the sequences, filled up to ``length`` with ``pad_id`` unless their
    number of tokens is a power of two.  A group is one sequence, so it has a fixed size."""
    pad = F.lit(bytearray(np.array([pad_id], "<u4").tobytes()))
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("tokens"),
                 F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", "tokens",
                    F.aggregate("parts", F.lit(bytearray()), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
            .withColumn("ids", F.when(F.expr("tokens & (tokens - 1)") == 0, F.col("ids"))
                        .otherwise(F.rpad("ids", 4 * length, pad))))


# the library's pattern of this vocabulary; letters and marks of these ranges are alike in every Unicode version
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OTHER = re.compile("[^\x00-\x1b\x20-ͷЀ-ԯ‐-‧]|Σ")
KEPT = 150_000                             # words, and pieces, that a worker remembers, at least
WORD = 64                                  # letters up to which it does


@functools.cache                           # once a worker
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts -> ids (little-endian unsigned 32 bits) by the ``tokenizers`` library's file ``path``, of the
    kind that normalises (NFC, white space, lower case), splits by PIECE and merges
    within each piece, so that no token spans white space.

    Words are split at white space and remembered; a new word's pieces go through the library's
    merges.  Texts with other characters (scripts whose letters changed between versions of
    Unicode, control separators, a capital sigma, whose lower case depends on its place)
    go through the library as they are.  Special tokens in a text are ordinary text.
    """
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    split, merged = regex.compile(PIECE).findall, whole.model.tokenize
    spelling = str.maketrans({chr(i): c for i, c in enumerate(_spelled_bytes())})

    def piece(p: str) -> bytes:
        spelled = p if p.isascii() and p.isalpha() else p.encode().decode("latin-1").translate(spelling)
        return np.array([t.id for t in merged(spelled)], "<u4").tobytes()

    def word(w: str) -> bytes:
        if w.isascii() and w.isalpha():
            return piece(w)
        return b"".join([pieces[p] for p in split(w)])

    words, pieces = _Recent(word), _Recent(piece)

    def text(x: str) -> bytes:
        if not x.isascii() or any(c in x for c in "\x1c\x1d\x1e\x1f"):
            if OTHER.search(x):
                return np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
            x = unicodedata.normalize("NFC", x)
        return b"".join(map(words.__getitem__, x.lower().split()))

    return lambda texts: [text(x) for x in texts]


class _Recent(dict):
    """A function of short words, with its last results: between KEPT and twice as many."""

    def __init__(self, of: Callable[[str], bytes]):
        super().__init__()
        self.of, self.old = of, {}

    def __missing__(self, w: str) -> bytes:
        out = self.old.get(w) or self.of(w)
        if len(w) <= WORD:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[w] = out
        return out


def _spelled_bytes() -> str:
    """The character that spells each byte in a byte-level vocabulary: itself where it is printable and
    no blank, else the next one from 256 on."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return "".join(chr(b) if s else chr(256 + shown[:b].count(False)) for b, s in enumerate(shown))
