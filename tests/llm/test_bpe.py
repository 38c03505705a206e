"""Byte-level BPE against the public library, and back."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from casebase.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    letters = "abcdefghij ABC'é,.\n\t 019ßñ😀Ω\x1c　 "
    yield from [None, "", " ", "  ", "\n", "a", "a  ", " 's 're l'été don't", "12345 ²½Ⅷ", "x\x1c \x1f y",
                "tab\t x", "　wide　", "a,b.c;d  ,e", "word" * 40, "a" * 2000, "aab" * 700, "!" * 300,
                " " * 500, "<|endoftext|>", "\u0000￿", "the " * 4000]
    for n in (3, 10, 50, 200):
        for _ in range(30):
            yield "".join(rng.choice(letters) for _ in range(n))
    yield "".join(rng.choice("abcdefgh") for _ in range(400))


def test_like_the_library_and_back(codec, library):
    given = list(texts())
    ids = codec.encode(given)
    for t, x in zip(given, ids, strict=True):
        assert np.frombuffer(x, "<u4").tolist() == library.encode_ordinary(t or ""), t[:40]
    assert codec.decode(ids) == [(t or "").encode() for t in given]


def test_small_chunks_and_caches(codec, library, monkeypatch):
    for name, value in (("CHUNK_BYTES", 50), ("CACHE_ENTRIES", 30), ("GROUP_BYTES", 100), ("BLOCK", 7)):
        monkeypatch.setattr(bpe, name, value)
    given = list(texts())[20:70]
    ids = codec.encode(given)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in given]
    assert codec.decode(ids) == [t.encode() for t in given]


def test_decode_any_ids(codec):
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 50256, n).astype("<u4").tobytes() for n in (0, 1, 5, 1000)]
    token = {r: b for b, r in codec.ranks.items()}
    assert codec.decode(ids) == [b"".join(token[i] for i in np.frombuffer(x, "<u4").tolist()) for x in ids]
    with pytest.raises(ValueError):
        codec.decode([np.array([60_000], "<u4").tobytes()])


def test_safe_ranks_of_a_toy_table():
    ranks = {b"a": 0, b"b": 1, b"abb": 2, b"ab": 3, b"bb": 4}
    t = bpe.merge_table(ranks).to_pylist()
    by = {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): (r["rank"], r["safe"]) for r in t}
    assert by == {(0, 1): (3, False), (1, 1): (4, False), (0, 4): (2, True), (3, 1): (2, True)}


def test_frames(spark, library):
    rows = [(1, "one two", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"), (3, "été " * 9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in bpe.roundtrip_digests(df, PATH, P.PATTERN).collect()}
    want = set()
    for k, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.add((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.roundtrip_digests(df.where(F.lit(False)), PATH, P.PATTERN).count() == 0
