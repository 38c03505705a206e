"""SimHash: fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casebase.llm import simhash
from casebase.llm.common import connected
from casebase.session import cut_lineage


def plain_fingerprint(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, max_bits):
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v
    vals = sorted(group)
    for i, a in enumerate(vals):
        for b in vals[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    out = {}
    for v in vals:
        out.setdefault(root(v), set()).add(v)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "One", "one TWO", "a b c", "a b c a b c a b c", "Ünï Ä b\x0bc\x1cd e f",
    "x y z w", "word " * 5000, "q" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_slices(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("max_bits,unit_rows", [(3, 4096), (3, 4), (2, 3), (0, 2), (5, 8)])
def test_links_like_brute_force(spark, max_bits, unit_rows):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    values = set(base.tolist()) | {0, 2**64 - 1, 1, 7, 2**63}
    for v in base[:25].tolist():
        for _ in range(6):
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                v ^= 1 << int(b)
            values.add(v)
    hot = int(base[0]) >> 48 << 48                      # a prefix with many fingerprints
    values |= {hot | int(x) >> 16 for x in rng.integers(0, 2**64, 60, dtype=np.uint64)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(df, max_bits, unit_rows)
    label = {r.v: r.label for r in connected(edges, cut_lineage).collect()}
    found = {}
    for v in signed:
        found.setdefault(label.get(v, v), []).append(v % 2**64)
    assert sorted(map(sorted, found.values())) == plain_components(values, max_bits)


def test_walk_in_small_fronts(monkeypatch):
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**12, 300, dtype=np.uint64))
    whole = simhash.walk(fp, np.array([[0, len(fp), 0, len(fp)]]), 0, 1)
    monkeypatch.setattr(simhash, "FRONT", 50)
    assert (simhash.walk(fp, np.array([[0, len(fp), 0, len(fp)]]), 0, 1) == whole).all()


def test_rows(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "A b C d e f g", "y"), (3, "A b C d e f g", "y"),
            (None, "a b c d e f g", None), (9, None, "z"), (8, "", "z"), (None, "other words are here", "q"),
            (4, "long " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fp", "component_id"]
    got = sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None), (4, 4)], key=str)
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def test_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r.v: r.label for r in connected(edges, cut_lineage).collect()}
    assert got == dict.fromkeys(range(201), 0)
