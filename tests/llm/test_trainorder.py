"""Training order: the permutation, the shards' bytes, resumed reads."""

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebase.llm import trainorder as T
from casebase.llm.common import shared_folder


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    order = T.Feistel(n, 42)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.number(slots) == np.arange(n)).all()
    if n == 1000:
        assert (slots != T.Feistel(n, 43).slot(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.15


def test_large_domain():
    order = T.Feistel(10**13 + 7, 1)
    x = np.arange(10**13 - 500, 10**13 + 7)
    assert (order.number(order.slot(x)) == x).all() and order.slot(x).max() < order.n


@pytest.fixture
def encoder():
    return lambda: lambda text: np.frombuffer(text.encode(), np.uint8)


def _docs(spark):
    rows = [(i, "abcdefghij"[: i % 11] * (1 + i % 5), "z") for i in range(100)]
    rows += [(None, "no key", "y"), (7, None, "x"), (8, "", "x"), (9, "again", "x"), (9, "again", "x"),
             (200, "long" * 30_000, "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_shards(spark, encoder, id_bytes):
    rows, df = _docs(spark)
    folder = shared_folder(spark, "order")
    shards = T.materialise(df, encoder, folder, length=16, seed=3, shard_slots=100, id_bytes=id_bytes)
    want = sorted((repr(k), i // 16, t[i:i + 16]) for k, t, _ in rows for i in range(0, len(t or ""), 16))
    got = T.read_shards(shards, 16, id_bytes=id_bytes, chunk=7).collect()
    kind = f"<u{id_bytes}"
    text = lambda r: bytes(np.frombuffer(r.ids, kind).astype(np.uint8)).decode()
    assert sorted(r.slot for r in got) == list(range(len(want)))
    assert sorted((repr(r.key), r.part, text(r)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // id_bytes for r in got)
    # the files: fixed stride, whole, in slot order
    files = sorted(Path(folder.removeprefix("file:")).glob("shard-*.bin"))
    stride = 16 + 16 * id_bytes
    assert [f.stat().st_size // stride for f in files] == [100] * (len(want) // 100) + [len(want) % 100]
    assert not [f for f in files[0].parent.iterdir() if f.suffix == ".tmp"]
    one = next(r for r in got if r.slot == 150)
    raw = files[1].read_bytes()[50 * stride:51 * stride]
    assert struct.unpack("<qii", raw[:16]) == (-2**63 if one.key is None else one.key, one.part, one.n_tokens)
    assert raw[16:16 + len(one.ids)] == bytes(one.ids) and not any(raw[16 + len(one.ids):])
    part = T.read_shards(shards, 16, first=95, stop=210, id_bytes=id_bytes).collect()
    assert sorted((r.slot, bytes(r.ids)) for r in part) == sorted(
        (r.slot, bytes(r.ids)) for r in got if 95 <= r.slot < 210)


def test_small_packs_make_the_same_files(spark, encoder, monkeypatch):
    _, df = _docs(spark)
    df = df.coalesce(1)
    read = lambda: sorted((r.slot, r.key, r.part, bytes(r.ids)) for r in T.read_shards(
        T.materialise(df, encoder, shared_folder(spark, "order"), length=16, seed=3), 16).collect())
    whole = read()
    monkeypatch.setattr(T, "HELD", 64)
    assert read() == whole


def test_no_rows_and_large_ids(spark, encoder):
    _, df = _docs(spark)
    none = T.materialise(df.where(F.lit(False)), encoder, shared_folder(spark, "order"), length=16, seed=3)
    assert none.count() == 0 and T.read_shards(none, 16).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        T.materialise(df, lambda: lambda t: np.array([70_000] * len(t)), shared_folder(spark, "order"),
                      length=16, seed=3)
