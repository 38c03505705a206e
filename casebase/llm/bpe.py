"""Byte-level BPE encoding and decoding by DuckDB queries inside Spark tasks.

Spark partitions the documents; inside a task every *distinct* piece of a
batch is encoded once.  The merges are a recursive DuckDB query over
token-position rows: rows join the merge table, each word's leftmost pair of
minimum rank is contracted, and words without a mergeable pair leave the
recursion.  Decoding is an ordered aggregation of the token bytes, once for each distinct
run of ids between tokens that open with neither a letter nor a digit.

Pieces are the matches of the public split pattern.  A text is first cut
before single blanks that follow a non-blank character: no match spans such a
place, so segments can be matched (and remembered) on their own.

Defined cases: a NULL or empty text has no ids and decodes to no bytes; ids
without an entry in the vocabulary raise; repeated rows give repeated results;
columns besides the key and the text are ignored; an empty table gives an
empty result.  Memory in a task is bounded by the batch, by ``CHUNK_BYTES``
and by the ``remember`` pieces (at least, and half of the most, each way) that a worker keeps.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import release, worker_state

CHUNK_BYTES = 400_000        # bytes of distinct pieces in one recursive query
# a worker's memory: vocabulary and merges 60 MB, the caches 80 MB, DuckDB as below, and about
# 20 times GROUP_BYTES for what is worked on
CACHE_ENTRIES = 100_000      # pieces remembered unless told otherwise: the share of a stage among others
GROUP_BYTES = 4_000_000      # bytes of texts or ids that are worked on together
ENGINE_MEMORY = "128MB"      # of DuckDB; beyond, it spills to the task's temporary folder
CACHE_LEN = 64               # longer pieces are not remembered
LONG_PIECE = 48              # pieces above this contract equal ranks together
MARKS = ".,;:!?*#$%&|)"      # ASCII marks that often end a segment

# one contraction a round and word: the leftmost pair of minimum rank.  ``id`` is
# the byte offset of a token (one id is left free between words), so the next
# token is at id + len; ``best`` packs rank, id and length of the merged token
_SHORT = """
WITH RECURSIVE t(w, id, len, tok, live) AS (
  SELECT w, id, 1, tok, true FROM init
  UNION ALL
  SELECT w, id, CASE WHEN id = p THEN (best & 4095)::INTEGER ELSE len END,
         CASE WHEN id = p THEN (best >> 44)::INTEGER ELSE tok END, best IS NOT NULL
  FROM (SELECT a.*, b.best, (b.best >> 12) & 4294967295 AS p
        FROM t a LEFT JOIN (
          SELECT x.w, min((m.rank::BIGINT << 44) | (x.id << 12) | m.len) AS best
          FROM t x JOIN t y ON y.id = x.id + x.len
          JOIN merges m ON m.pair = (x.tok::BIGINT << 32) | y.tok
          WHERE x.live AND y.live GROUP BY x.w) b ON a.w = b.w
        WHERE a.live)
  WHERE best IS NULL OR id <= p OR id >= p + (best & 4095)
)
SELECT w, id, tok FROM t WHERE NOT live ORDER BY id
"""

# long words: all pairs of the minimum rank are contracted left to right in one
# round, where no merge of that rank can make a pair of a lower rank ("safe");
# in a run of overlapping pairs every second one, from the left
_LONG = """
WITH RECURSIVE t(w, id, tok, live) AS (
  SELECT w, id, tok, true FROM init
  UNION ALL
  SELECT w, id, CASE WHEN hit THEN (best >> 32)::INTEGER ELSE tok END, best IS NOT NULL
  FROM (SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY id), false) AS gone
        FROM (SELECT *, coalesce(low AND (id = best & 4294967295
                                 OR safe AND (rn - brk) % 2 = 1), false) AS hit
              FROM (SELECT *, coalesce(max(CASE WHEN low THEN NULL ELSE rn END)
                              OVER (PARTITION BY w ORDER BY id
                                    ROWS UNBOUNDED PRECEDING), 0) AS brk
                    FROM (SELECT *, coalesce(key >> 32 = best >> 32, false) AS low
                          FROM (SELECT *, min(key) OVER (PARTITION BY w) AS best
                                FROM (SELECT p.*, m.safe,
                                             (m.rank::BIGINT << 32) | p.id AS key
                                      FROM (SELECT w, id, tok, row_number() OVER s AS rn,
                                                   (tok::BIGINT << 32) | lead(tok) OVER s AS pair
                                            FROM t WHERE live
                                            WINDOW s AS (PARTITION BY w ORDER BY id)) p
                                      LEFT JOIN merges m ON m.pair = p.pair))))))
  WHERE NOT gone
)
SELECT w, id, tok FROM t WHERE NOT live ORDER BY id
"""

# bytes as the characters of the same number; U+0100 ends a run
_END = "\u0100"
_DECODE = """
SELECT string_agg(v.chars, '' ORDER BY c.pos) AS chars
FROM ids c JOIN vocab v ON v.id = c.id GROUP BY c.block ORDER BY c.block
"""
BLOCK = 10_000               # ids in one ordered aggregate


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one line ``base64(bytes) rank`` a token."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose concatenation is a token: (pair, rank, len, safe).

    ``safe``: no pair that the merged token can be part of has a lower rank.
    """
    unsafe, rows = set(), []
    for x, r in ranks.items():
        for i in range(1, len(x)):
            u, v = ranks.get(x[:i]), ranks.get(x[i:])
            if u is None or v is None:
                continue
            rows.append(((u << 32) | v, r, len(x)))
            unsafe.update(y for y in (u, v) if y > r)
    pair = np.array([p for p, _, _ in rows], dtype=np.int64)
    rank = np.array([r for _, r, _ in rows], dtype=np.int32)
    size = np.array([n for _, _, n in rows], dtype=np.int32)
    if len(size) and size.max() >= 4096:
        raise ValueError("a token has 4096 bytes or more")
    safe = ~np.isin(rank, np.fromiter(unsafe, dtype=np.int32, count=len(unsafe)))
    return pa.table({"pair": pair, "rank": rank, "len": size, "safe": safe})


class Codec:
    """Encoder and decoder of one task; holds one DuckDB connection."""

    def __init__(self, path: str, pattern: str, remember: int | None = None):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.blank = regex.compile(r"[\s\x1c-\x1f] ").search
        single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.single = np.array(single, dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": ENGINE_MEMORY,
                                          "temp_directory": tempfile.gettempdir()})
        merges = merge_table(self.ranks)
        self.con.register("merges_in", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        size = max(self.ranks.values(), default=0) + 1
        self.end = size                    # the id of the mark between runs
        chars, self.opens = [""] * size + [_END], np.zeros(size, dtype=bool)
        self.known = np.zeros(size, dtype=bool)
        for x, r in self.ranks.items():
            chars[r], self.opens[r], self.known[r] = x.decode("latin-1"), x[0] < 128 and not x[:1].isalnum(), True
        self.con.register("vocab_in", pa.table({"id": np.arange(size + 1, dtype=np.int32),
                                                "chars": chars}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.pieces, self.chunks = _Recent(CACHE_LEN, remember), _Recent(4 * CACHE_LEN, remember)

    # -- encoding ---------------------------------------------------------
    def _cut(self, text: str) -> list[str]:
        """Places where no match of the pattern can span: before a blank that
        follows a non-blank character."""
        if self.blank(text):
            return self.find(text)
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        if first:
            out.insert(0, first)
        return out

    def _merge(self, pieces: list[bytes], query: str) -> list[bytes]:
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        tok = self.single[raw]
        if (tok < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)
        self.con.register("init", pa.table({"w": w, "id": np.arange(len(raw)) + w, "tok": tok}))
        got = self.con.sql(query).to_arrow_table()
        self.con.unregister("init")
        flat = got.column("tok").to_numpy().astype("<u4").tobytes()
        count = np.bincount(got.column("w").to_numpy(), minlength=len(pieces))
        ends = [0, *(np.cumsum(count) * 4).tolist()]
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _split(self, segment: str) -> list[str]:
        """The matches of the pattern; for ``letters marks`` without the pattern."""
        word = segment.rstrip(MARKS)
        if word.isalpha() or word[:1] == " " and word[1:].isalpha():
            return [word, segment[len(word):]] if len(word) < len(segment) else [word]
        return self.find(segment)

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids (little-endian 32-bit) of new pieces."""
        out, todo, size = self.pieces, ([], []), [0, 0]

        def flush(i):
            if todo[i]:
                got = self._merge([x for _, x in todo[i]], (_SHORT, _LONG)[i])
                out.update((p, g) for (p, _), g in zip(todo[i], got, strict=True))
                todo[i].clear()
                size[i] = 0

        for p in pieces:
            x = p.encode("utf-8")
            r = self.ranks.get(x)
            if r is not None:
                out[p] = r.to_bytes(4, "little")
                continue
            i = int(len(x) > LONG_PIECE)
            todo[i].append((p, x))
            size[i] += len(x)
            if size[i] >= CHUNK_BYTES:
                flush(i)
        flush(0)
        flush(1)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        return [x for part in _groups(texts) for x in self._encode(part)]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._cut(x) if x else [] for x in texts]
        parts = {s: self._split(s) for s in set().union(*cut)}
        new = self.pieces.missing(set().union(*parts.values()))
        self._learn(new)
        known = self.pieces
        ids = {s: known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
               for s, ps in parts.items()}
        known.trim(new)
        return [b"".join(map(ids.__getitem__, segs)) for segs in cut]

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of every id sequence."""
        return [x for part in _groups(ids) for x in self._decode(part)]

    def _decode(self, ids: list[bytes]) -> list[bytes]:
        runs = []
        for x in ids:
            a = np.frombuffer(x, dtype="<u4")
            if len(a) and (a.max() >= len(self.known) or not self.known[a].all()):
                raise ValueError("an id is not in the vocabulary")
            cuts = np.flatnonzero(self.opens[a]) * 4
            ends = [0, *cuts[cuts > 0].tolist(), len(x)]
            runs.append([x[p:q] for p, q in zip(ends, ends[1:], strict=False)])
        new = list(self.chunks.missing(set().union(*runs)))
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and size < CHUNK_BYTES:
                size += len(new[end]) // 4 + 1
                end += 1
            self.chunks.update(zip(new[at:end], self._bytes(new[at:end]), strict=True))
            at = end
        out = [b"".join(map(self.chunks.__getitem__, r)) for r in runs]
        self.chunks.trim(new)
        return out

    def _bytes(self, runs: list[bytes]) -> list[bytes]:
        mark = self.end.to_bytes(4, "little")
        flat = np.frombuffer(mark.join(runs), dtype="<u4").astype(np.int32)
        pos = np.arange(len(flat), dtype=np.int64)
        self.con.register("ids", pa.table({"block": pos // BLOCK, "pos": pos, "id": flat}))
        got = self.con.sql(_DECODE).to_arrow_table()
        self.con.unregister("ids")
        return [x.encode("latin-1")
                for x in "".join(got.column("chars").to_pylist()).split(_END)]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about GROUP_BYTES of its second column."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    group = np.cumsum(size.astype(np.int64)) // GROUP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def _groups(rows: list) -> Iterator[list]:
    """The rows in runs of about GROUP_BYTES; bounds what a batch takes in memory."""
    at = size = 0
    for i, x in enumerate(rows):
        if size and size + len(x or "") > GROUP_BYTES:
            yield rows[at:i]
            at, size = i, 0
        size += len(x or "")
    yield rows[at:]


class _Recent(dict):
    """What was looked up last: the entries of this generation and of the one before."""

    def __init__(self, longest: int, most: int | None):
        super().__init__()
        self.longest, self.most, self.before = longest, most, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are new; the others are in this generation from now on."""
        keys = keys.difference(self)
        again = keys.intersection(self.before)
        self.update((k, self.before[k]) for k in again)
        return keys - again

    def trim(self, new) -> None:
        """Forget long entries, and the generation before if this one is full."""
        for x in new:
            if len(x) > self.longest:
                del self[x]
        if len(self) > (self.most or CACHE_ENTRIES):
            self.before = dict(self)
            self.clear()


def codec(path: str, pattern: str, remember: int | None = None) -> Codec:
    """The worker's codec of a vocabulary; kept between tasks of one worker."""
    return worker_state(("bpe", os.getpid(), path, pattern, remember), lambda: Codec(path, pattern, remember))


def encode(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``(key, ids binary)``: the ids as little-endian unsigned 32-bit integers."""
    return _apply(docs, path, pattern, key, text, digests=False)


def decode(encoded: DataFrame, path: str, pattern: str, *, key: str = "doc_id",
           ids: str = "ids") -> DataFrame:
    """``(key, bytes binary)`` of the ids that ``encode`` gives; NULL ids give no bytes."""
    ship_package(encoded.sparkSession)
    src = encoded.select(F.col(key).alias("_k"), F.col(ids).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in (part for whole in batches for part in _parts(whole)):
            got = c.decode([x or b"" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())],
                                             ["_k", "_b"])

    kind = encoded.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"_k {kind}, _b binary").toDF(key, "bytes")


def roundtrip_digests(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id",
                      text: str = "text", with_ids: bool = False, remember: int | None = None) -> DataFrame:
    """Encode, decode the ids again, and return per row
    ``(key, n_tokens, ids_sha256, decoded_sha256)``, and the ``ids`` if asked for.  ``remember`` costs
    memory (about 1 kB a piece, not measured) and saves merges."""
    return _apply(docs, path, pattern, key, text, digests=True, with_ids=with_ids, remember=remember)


def _apply(docs, path, pattern, key, text, digests, with_ids=True, remember=None):
    ship_package(docs.sparkSession)
    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_x"))
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, remember)
        for b in (part for whole in batches for part in _parts(whole)):
            ids = c.encode(b.column(1).to_pylist())
            if not digests:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())],
                                                 ["_k", "ids"])
                continue
            back = c.decode(ids)
            cols = [pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["_k", *names[:len(cols)]])
            del ids, back, cols
            release()

    kind = docs.schema[key].dataType.simpleString()
    if not digests:
        return src.mapInArrow(run, f"_k {kind}, ids binary").toDF(key, "ids")
    types = ["long", "string", "string", "binary"][:3 + with_ids]
    return src.mapInArrow(run, f"_k {kind}, " + ", ".join(
        f"{n} {t}" for n, t in zip(names, types, strict=False))).toDF(key, *names[:len(types)])
