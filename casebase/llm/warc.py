"""WARC archives: write, normalise monolithic gzip files, read back by index.

``write_archives`` writes one ``.warc.gz`` a task as a single gzip stream, as simple
writers do; such a file can only be read from its beginning.  ``normalise`` inflates each
file once, record by record, writes every record as a gzip member of its own, and puts
a sidecar index (JSON lines: offset, length, type) beside the new file.
``read_archives`` deals the index entries, not the files, to tasks, which
read just those members.

Pages with equal payloads of at least ``least_bytes`` bytes are written once: the one with the
smallest key is the response, the others are revisit records that refer to it.

Files are named by task and put in place by a rename, so a repeated task
leaves the same file; paths are URIs of the shared folder.

Defined cases: a NULL payload is empty; a NULL URL leaves the header out; control characters
of a URL are percent-encoded in the header; rows that repeat the smallest key of a
payload are all responses; a NULL key comes after all others and is never
referred to unless the group has no other (then all are responses); an empty table writes
no file and gives an empty result; other columns are ignored.  Payloads are held
one at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

BLOCK = 1 << 20
GZIP = 31                                  # zlib window bits of the gzip format
DATE = "2024-01-01T00:00:00Z"              # one date, so that equal pages make equal files
FILES = "path string, records long"
INDEX = "path string, offset long, length long, type string"


# -- records -----------------------------------------------------------------
def _record_id(key, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{key}:{digest}").urn


def make_record(key, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record; a revisit (``refers_to`` is not None) has no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_record_id(key, digest)}>"),
            ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(
            c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode())
            for c in url)))
    if key is not None:
        head.append(("X-Page-ID", str(key)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<{_record_id(refers_to, digest)}>"),
                 ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() \
        + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, raw record) of every record of an inflated WARC stream."""
    held = bytearray()
    chunks = iter(chunks)
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(chunks, None)
            if more is None:
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
            held += more
        head = headers(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            more = next(chunks, None)
            if more is None:
                raise ValueError("the archive ends within a record")
            held += more
        yield head, bytes(held[:size])
        del held[:size]


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in bounded blocks."""
    z = zlib.decompressobj(GZIP)
    while data := stream.read(BLOCK):
        while data:
            yield z.decompress(data, BLOCK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, BLOCK)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(GZIP)
    if tail := z.flush():
        yield tail


def deflate(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


class _Place:
    """A new file of the shared folder that appears under its name when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        folder = self.path.rpartition("/")[0]
        self.fs.create_dir(folder, recursive=True)
        self.temp = f"{folder}/.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


# -- jobs --------------------------------------------------------------------
def with_revisits(pages: DataFrame, *, key: str = "page_id", url: str = "url",
                  payload: str = "html", least_bytes: int = 100) -> DataFrame:
    """``(key, url, payload binary, digest, size, refers_to)``.

    Payloads are only moved for the join on the (well spread) key; which of
    equal payloads is first is decided on digests alone.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"),
                        F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    light = rows.where(F.col("size") >= least_bytes).select("key", "digest")
    first = (light.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
             .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    later = (light.join(first, "digest").where(~F.col("key").eqNullSafe(F.col("first")))
             .distinct().withColumnsRenamed({"key": "_key", "digest": "_digest"}))
    return (rows.join(later, rows["key"].eqNullSafe(later["_key"])
                      & (rows["digest"] == later["_digest"]), "left")
            .select("key", "url", "payload", "digest", "size", F.col("first").alias("refers_to")))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``with_revisits`` rows, a single gzip stream a task; returns ``(path, records)``."""
    ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n = None, 0
        path = f"{folder}/whole-{TaskContext.get().partitionId():06d}.warc.gz"
        z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        for b in batches:
            for row in zip(*b.columns, strict=True):
                key, url, payload, digest, size, refers_to = (x.as_py() for x in row)
                place = place or _Place(path)
                place.out.write(z.compress(make_record(key, url, payload, digest, size, refers_to)))
                n += 1
        if place is not None:
            place.out.write(z.flush())
            place.done()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())],
                                             ["path", "records"])

    return cut_lineage(records.mapInArrow(run, FILES))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives ``files(path)`` with one gzip member a record; each gets a sidecar
    index.  Returns ``(path, records)`` of the new files."""
    spark = files.sparkSession
    ship_package(spark)
    tasks = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                name = path.rpartition("/")[2].removeprefix("whole-").removesuffix(".warc.gz")
                new = f"{folder}/members-{name}.warc.gz"
                place, index, at, n = _Place(new), _Place(f"{folder}/members-{name}.index.json"), 0, 0
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner, compression=None) as stream:
                    for head, raw in split_records(inflate(stream)):
                        member = deflate(raw)
                        place.out.write(member)
                        index.out.write((json.dumps(
                            {"path": new, "offset": at, "length": len(member),
                             "type": head.get("warc-type")}) + "\n").encode())
                        at, n = at + len(member), n + 1
                place.done()
                index.done()
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n], pa.int64())],
                                                 ["path", "records"])

    return cut_lineage(files.select("path").repartition(tasks, "path").mapInArrow(run, FILES))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder: ``(path, offset, length, type)``."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(folder)


def read_archives(index: DataFrame, key_type: str = "long") -> DataFrame:
    """``(key, payload_bytes, payload_digest, record_type, refers_to)`` of the indexed records.

    A response's figures are those of the payload that was read, and must agree
    with its headers; a revisit's are in its headers.
    """
    spark = index.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            rows = []
            for path, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if path != name:
                    fs, inner = pafs.FileSystem.from_uri(path)
                    name, file = path, fs.open_input_file(inner)
                raw = zlib.decompress(file.read_at(length, offset), GZIP)
                head = headers(raw[:raw.index(b"\r\n\r\n")])
                block = raw[len(raw) - 4 - int(head["content-length"]):-4]
                cut = block.index(b"\r\n\r\n") + 4
                size = int(headers(block[:cut - 4])["content-length"])
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response":
                    payload = block[cut:]
                    if (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                        raise ValueError(f"a damaged payload in {path} at {offset}")
                rows.append((head.get("x-page-id"), size, digest, head["warc-type"],
                             head.get("x-refers-to-page")))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(),
                                                       pa.string(), pa.string()), strict=True)], names)

    found = (index.select("path", "offset", "length").repartitionByRange(n, "path", "offset")
             .sortWithinPartitions("path", "offset")
             .mapInArrow(run, "key string, payload_bytes long, payload_digest string, "
                              "record_type string, refers_to string"))
    return found.withColumns({"key": F.col("key").cast(key_type),
                              "refers_to": F.col("refers_to").cast(key_type)})
