"""Training order on disk: a keyed permutation of all sequences into fixed-stride shards.

Token sequences get gapless numbers, and a keyed Feistel network with cycle-walking
permutes those numbers: every sequence has a global slot that anyone can compute from
the key, and back.  Spark deals the sequences to tasks by slot range; a task writes its
shard as records of one fixed length, so the sequence of a slot is at
``slot % shard_slots * stride`` of shard ``slot // shard_slots``: training reads files from front to
back and resumes at any slot by a seek.

A record is the sequence's key (8 bytes), its number within the document and its token
count (4 bytes each), and ``length`` token ids of 2 or 4 bytes, filled up with zeros.

Documents are tokenised once and cut into sequences of ``length`` ids; a whole text is used.
The token table is written once; sequences are numbered in its order (the sums of the
counts of the partitions before are added), so nothing is sorted.  Sequences are moved once:
a task packs those of a shard into compressed blocks, and the shard's task puts
them in their places.  A shard, the largest thing in a task, has a fixed size.

Defined cases: a NULL or empty text has no sequence; NULL keys are written as the smallest
64-bit integer and read back as NULL; repeated rows make repeated sequences; an empty table writes no
shard and reads back as an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .warc import _Place

HEAD, SLOT = "<qii", "<q"                  # fixed formats: key, part, tokens; slot
HEAD_SIZE, SLOT_SIZE = struct.calcsize(HEAD), struct.calcsize(SLOT)
NO_KEY = -2**63
ROUNDS = 4
PRESS = 9                                  # zstd level of what is held or shuffled
PACK = 4 << 20                             # bytes of ids in a row of the token table
HELD = 32 << 20                            # bytes of sequences that a task packs together


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big")
                     for i in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: int) -> np.ndarray:
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)     # wraps modulo 2**64
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.uint64), back)
        while (out := np.flatnonzero(x >= self.n)).size:             # until within 0..n-1
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, number) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def tokenised(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], *,
              key: str = "doc_id", text: str = "text", id_bytes: int = 2) -> DataFrame:
    """``(keys, counts, ids)``: documents with tokens, their token counts, and their ids one after
    the other, compressed; as many documents a row as make about PACK bytes.

    ``encoder()`` is called once a task and returns the function from a text to ids.
    """
    ship_package(docs.sparkSession)
    kind = np.dtype(f"<u{id_bytes}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = encoder(), zstandard.ZstdCompressor(level=PRESS).compress
        keys, parts, size = [], [], 0

        def packed():
            row = pa.RecordBatch.from_arrays(
                [pa.array([list(keys)], pa.list_(pa.int64())),
                 pa.array([[len(x) // id_bytes for x in parts]], pa.list_(pa.int64())),
                 pa.array([press(b"".join(parts))], pa.binary())], ["keys", "counts", "ids"])
            keys.clear()
            parts.clear()
            return row
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.asarray(encode(x.as_py() or ""))
                if not len(ids):
                    continue
                if int(ids.max()) >= 256 ** id_bytes:
                    raise ValueError(f"an id does not fit {id_bytes} bytes")
                keys.append(k)
                parts.append(ids.astype(kind).tobytes())
                size += len(parts[-1])
                if size >= PACK:
                    yield packed()
                    size = 0
        if keys:
            yield packed()

    return (docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_x"))
            .mapInArrow(run, "keys array<long>, counts array<long>, ids binary"))


def materialise(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], folder: str, *,
                length: int, seed: int, key: str = "doc_id", text: str = "text", id_bytes: int = 2,
                shard_slots: int = 32_768) -> DataFrame:
    """Write the shards of ``docs``; returns ``(path, first_slot, n_slots)`` of each."""
    spark = docs.sparkSession
    # a written table: its partitions and their rows stay as they are from here on
    rows = cut_lineage(tokenised(docs, encoder, key=key, text=text, id_bytes=id_bytes))
    rows = rows.withColumns({"at": F.monotonically_increasing_id(),
                             "parts": F.expr(f"aggregate(counts, 0L, (a, c) -> "
                                             f"a + (c + {length - 1}) div {length})")})
    sums = (rows.groupBy(F.expr("shiftright(at, 33)").cast("int").alias("p"))
            .agg(F.sum("parts").alias("n")).collect())             # a number a partition
    n = sum(r.n for r in sums)
    first = np.zeros(max((r.p for r in sums), default=0) + 2, np.int64)
    for r in sums:
        first[r.p + 1] = r.n
    starts = spark.sparkContext.broadcast(np.cumsum(first))
    order = Feistel(max(n, 1), seed)
    stride = HEAD_SIZE + length * id_bytes
    count = max(1, -(-n // shard_slots))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences with their slots, packed by shard before they are shuffled."""
        open_ids = zstandard.ZstdDecompressor().decompress
        press = zstandard.ZstdCompressor(level=PRESS).compress
        held: dict[int, list[bytes]] = {}
        size, number = 0, None

        def packed():
            shards = sorted(held)
            out = [press(b"".join(held[x])) for x in shards]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()),
                                               pa.array(out, pa.binary())], ["shard", "blob"])
        for b in batches:
            for keys, counts, ids, at, parts in zip(*(b.column(i).to_pylist() for i in range(5)),
                                                    strict=True):
                if number is None:
                    number = int(starts.value[at >> 33])           # tasks read partitions whole
                slots = order.slot(np.arange(number, number + parts)).tolist()
                number, i, raw, begin = number + parts, 0, open_ids(ids), 0
                for k, n_tokens in zip(keys, counts, strict=True):
                    for part, p in enumerate(range(0, n_tokens, length)):
                        m = min(length, n_tokens - p)
                        body = raw[begin + p * id_bytes:begin + (p + m) * id_bytes]
                        held.setdefault(slots[i] // shard_slots, []).append(
                            struct.pack(SLOT, slots[i])
                            + struct.pack(HEAD, NO_KEY if k is None else k, part, m) + body)
                        size, i = size + len(body), i + 1
                    begin += n_tokens * id_bytes
                if size >= HELD:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is a shard: put every sequence in its place and write the file."""
        shard, whole, seen = None, bytearray(), 0
        for b in batches:
            for now, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if shard is None:
                    shard = now
                    whole = bytearray(stride * (min(n, (shard + 1) * shard_slots) - shard * shard_slots))
                raw, i = zstandard.ZstdDecompressor().decompress(x.as_py()), 0
                while i < len(raw):
                    slot, (_, _, m) = struct.unpack_from(SLOT, raw, i)[0], struct.unpack_from(HEAD, raw, i + SLOT_SIZE)
                    end = i + SLOT_SIZE + HEAD_SIZE + m * id_bytes
                    place = (slot - shard * shard_slots) * stride
                    whole[place:place + end - i - SLOT_SIZE] = raw[i + SLOT_SIZE:end]
                    i, seen = end, seen + 1
        if shard is None:
            return
        if seen * stride != len(whole):
            raise ValueError(f"shard {shard}: {seen} of {len(whole) // stride} sequences came")
        path = f"{folder}/shard-{shard:08d}.bin"
        place = _Place(path)
        place.out.write(bytes(whole))
        place.done()
        yield pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([shard * shard_slots], pa.int64()), pa.array([seen], pa.int64())],
            ["path", "first_slot", "n_slots"])

    dealt = rows.select("keys", "counts", "ids", "at", "parts").mapInArrow(deal, "shard int, blob binary")
    return cut_lineage(dealt.repartitionById(count, F.col("shard")).mapInArrow(
        write, "path string, first_slot long, n_slots long"))


def read_shards(shards: DataFrame, length: int, *, first: int = 0, stop: int | None = None,
                id_bytes: int = 2, chunk: int = 4096) -> DataFrame:
    """``(slot, key, part, n_tokens, ids)`` of the slots from ``first`` up to ``stop``."""
    ship_package(shards.sparkSession)
    stride = HEAD_SIZE + length * id_bytes
    last = 2**62 if stop is None else stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, end = max(first, begin), min(last, begin + n)
                if at >= end:
                    continue
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as file:
                    for i in range(at, end, chunk):
                        raw = file.read_at((min(end, i + chunk) - i) * stride, (i - begin) * stride)
                        cols: list[list] = [[], [], [], [], []]
                        for j in range(0, len(raw), stride):
                            k, p, t = struct.unpack_from(HEAD, raw, j)
                            ids = raw[j + HEAD_SIZE:j + HEAD_SIZE + t * id_bytes]
                            row = (i + j // stride, None if k == NO_KEY else k, p, t, ids)
                            for col, v in zip(cols, row, strict=True):
                                col.append(v)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(
                                cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()),
                                strict=True)], ["slot", "key", "part", "n_tokens", "ids"])

    return shards.mapInArrow(run, "slot long, key long, part int, n_tokens int, ids binary")
