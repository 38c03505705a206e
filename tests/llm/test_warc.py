"""WARC: records, monolithic streams, members and index, odd pages."""

import gzip
import hashlib
import io
import json
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casebase.llm import warc as W
from casebase.llm.common import shared_folder


def brute(rows, least=100):
    first = {}
    for k, _, h in rows:
        first.setdefault((h or "").encode(), []).append(k)
    out = []
    for k, _, h in rows:
        b = (h or "").encode()
        keys = [x for x in first[b] if x is not None]
        again = len(b) >= least and keys and k != min(keys)
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response",
                    min(keys) if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/ b\r\nX: y", "<p>é</p>" * 30), (2, None, "<p>é</p>" * 30), (3, "http://c", None),
        (4, "http://d", ""), (5, "é", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 20), (6, "u", "x" * 99),
        (7, "u", "x" * 99), (None, "n", "<p>é</p>" * 30), (None, "n", "only " * 40), (None, "n", "only " * 40),
        (1, "http://a", "<p>é</p>" * 30), (9, "big", "0123456789" * 300_000), (8, "big", "0123456789" * 300_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS],
                               "page_id long, url string, html string, digest string").repartition(3)
    folder = shared_folder(spark, "warc")
    whole = W.write_archives(W.with_revisits(df), folder + "/whole")
    members = W.normalise(whole, folder + "/members")
    index = W.read_index(spark, folder + "/members")
    got = sorted((tuple(r) for r in W.read_archives(index).collect()), key=str)
    assert got == brute(ROWS)
    assert sum(r.records for r in whole.collect()) == sum(r.records for r in members.collect()) == len(ROWS)

    path = lambda p: Path(p.removeprefix("file:"))
    for r in whole.collect():                      # one member: nothing follows the first one's end
        z = zlib.decompressobj(31)
        z.decompress(path(r.path).read_bytes())
        assert z.eof and not z.unused_data
    for r in members.collect():                    # each member is one record; the index is gapless
        raw, at = path(r.path).read_bytes(), 0
        entries = [json.loads(x) for x in path(r.path.replace(".warc.gz", ".index.json")).read_text().splitlines()]
        assert len(entries) == r.records
        for e in entries:
            assert e["offset"] == at
            z = zlib.decompressobj(31)
            record = z.decompress(raw[at:at + e["length"]])
            assert z.eof and not z.unused_data and record.startswith(b"WARC/1.1\r\n")
            assert len(list(W.split_records(iter([record])))) == 1
            at += e["length"]
        assert at == len(raw)
    old = b"".join(sorted(W_records(b"".join(gzip.decompress(path(r.path).read_bytes()) for r in whole.collect()))))
    new = b"".join(sorted(W_records(b"".join(gzip.decompress(path(r.path).read_bytes()) for r in members.collect()))))
    assert old == new


def W_records(raw):
    return [record for _, record in W.split_records(iter([raw]))]


def test_streams(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 11)
    records = [W.make_record(i, "u", b"x" * i, "d", i, None) for i in range(5)]
    one = gzip.compress(b"".join(records))
    many = b"".join(map(gzip.compress, records))
    for raw in (one, many):
        assert [r for _, r in W.split_records(W.inflate(io.BytesIO(raw)))] == records
    assert list(W.split_records(W.inflate(io.BytesIO(b"")))) == []
    with pytest.raises(ValueError):
        list(W.split_records(iter([records[4][:-10]])))


def test_damage_is_seen(spark):
    folder = shared_folder(spark, "warc")
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    bad = W.with_revisits(df).withColumn("digest", F.sha2(F.lit("other"), 256))
    W.normalise(W.write_archives(bad, folder + "/whole"), folder + "/members")
    with pytest.raises(Exception, match="damaged payload"):
        W.read_archives(W.read_index(spark, folder + "/members")).collect()


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = shared_folder(spark, "warc")
    assert W.normalise(W.write_archives(W.with_revisits(df), folder + "/w"), folder + "/m").count() == 0
