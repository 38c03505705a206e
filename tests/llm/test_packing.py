"""Packing against one piece after the other, and a round trip of the ids."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casebase.llm import packing as K

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def plain_packing(sizes, length):
    """What is left in each window, one piece after the other."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in left if r >= s]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else length) - s)
    return sorted(left)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.dictionaries(
    st.integers(1, n), st.integers(1, 30)))))
def test_counts_like_one_piece_after_the_other(case):
    length, counts = case
    steps, windows = K.best_fit_decreasing(counts, length)
    used, seen = defaultdict(int), Counter()
    for size, rank, n, each, first, at in steps:
        assert rank == seen[size] and n % each == 0
        seen[size] += n
        for j in range(n):
            assert used[first + j // each] == at + j % each * size   # gapless, in this order
            used[first + j // each] += size
    assert seen == Counter(counts) and sorted(used) == list(range(windows))
    assert sorted(length - u for u in used.values()) == plain_packing(Counter(counts).elements(), length)


def test_steps_are_bounded():
    rng = random.Random(1)
    steps, _ = K.best_fit_decreasing({s: rng.randint(1, 10**9) for s in range(1, 2049)}, 2048)
    assert len(steps) < 3 * 2048 * 11


def test_encoder_like_the_library(prose):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    rng = random.Random(2)
    letters = "aBé'sST ½²_-.́̈ñÑΣσ\x1c\x1f \n9٣Ǆʰ҂҃​\u0085"
    texts = ["", " ", "It's we'LL 'S x'D", "日本語 text", "<|endoftext|> x", "ΑΣ ΣΑ", "a" * 3000, "ª º µ İ ŉ",
             prose("bb", 400, 1), *("".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(4000)),
             *(chr(c) + "a" + chr(c) for c in range(0x600)), *("b" + chr(c) for c in range(0x2000, 0x2070))]
    got = K.word_encoder(PATH)(texts * 2)
    for x, ids in zip(texts * 2, got, strict=True):
        assert ids == np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def _lengths():
    """An encoder from words to their lengths (not of this module, so that tasks can have it)."""
    def encoder():
        import numpy as np
        return lambda texts: [np.array([len(w) for w in x.split()], "<u4").tobytes() for x in texts]
    return encoder


_encoder = _lengths()


@pytest.mark.parametrize("joined", [K.JOINED, 0])
def test_round_trip(spark, tmp_path, monkeypatch, joined):
    monkeypatch.setattr(K, "JOINED", joined)
    monkeypatch.setattr(K, "HELD", 200)
    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(2, 9) for _ in range(rng.choice([0, 3, 15, 16, 40]))) for _ in range(200)]
    texts += [None, "", None, "ab " * 5000] + [texts[7]] * 150
    rows = [(None if i == 9 else f"k{i % 190}", x, 5, "y") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, rank int, length string").repartition(5)
    pieces = K.cut(docs, _encoder, str(tmp_path / "p"), length=16, end_id=1)
    packed = K.pack(pieces, 16)
    got = packed.collect()
    whole = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and 0 <= r.start and r.start + r.length <= r.doc_tokens
        whole[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    want = Counter((k, _encoder()([x or ""])[0] + b"\1\0\0\0") for k, x, _, _ in rows)
    assert sum(want.values()) == len(rows)
    assert sum(len(r.ids) for r in got) == sum(len(v) * n for (_, v), n in want.items())
    for (k, ids), n in want.items():
        for start in range(0, len(ids), 64):
            assert whole[k, len(ids) // 4].count((start // 4, ids[start:start + 64])) >= n
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for parts in windows.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 16
    assert sorted(16 - sum(s for _, s in p) for p in windows.values()) == \
        plain_packing([r.length for r in got], 16)
    texts = {r.sequence_id: r for r in K.sequences(packed, 16, 0).collect()}
    for k, parts in windows.items():
        used = sum(s for _, s in parts)
        assert texts[k].tokens == used
        assert len(texts[k].ids) == (4 * used if used & (used - 1) == 0 else 64)
    r = got[5]
    assert bytes(texts[r.sequence_id].ids)[4 * r.offset:][:len(r.ids)] == bytes(r.ids)


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    packed = K.pack(K.cut(docs, _encoder, str(tmp_path / "p"), length=16, end_id=1), 16)
    assert packed.count() == 0 and K.sequences(packed, 16, 0).count() == 0
