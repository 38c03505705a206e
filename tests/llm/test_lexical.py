"""Ranked lexical search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from casebase.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(docs, queries, k):
    docs = [(key, Counter(plain_terms(x))) for key, x in docs]
    docs = [(key, c, sum(c.values())) for key, c in docs if c]
    n, total = len(docs), sum(size for _, _, size in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for q, x in queries:
        scored = []
        for key, c, size in docs:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain_terms(x)) if t in c)
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out += [(q, i, key, -s) for i, (s, _, _, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, queries, folder, k=10, kind="long"):
    d = spark.createDataFrame(docs, "doc_id long, text string, rank string, score string")
    q = spark.createDataFrame(queries, f"item_id {kind}, text string, query string, keys int")
    blocks = lexical.index(d.repartition(3), str(folder))
    return sorted((tuple(r) for r in lexical.search(blocks, q, k).collect()), key=repr)


def _texts(seed, n, words=60, most=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Ünder", "ÉT", "9a"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ".join(rng.choice(vocabulary, rng.integers(0, most), p=weight / weight.sum())) for _ in range(n)]


@pytest.mark.parametrize("block_docs, at_once", [(32_768, 64), (7, 1), (40, 5)])
def test_like_scoring_all(spark, tmp_path, monkeypatch, block_docs, at_once):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    docs = list(enumerate(_texts(1, 300)))
    docs += [(None, docs[3][1]), (3, docs[3][1]), (400, None), (401, ""), (402, "?! --"), (403, "w1"),
             (404, "W1 ünder\tw1\x00w2"), (-5, docs[9][1]), (405, "w2 " * 30_000), (406, "é" * 50_000)]
    docs += [(1000 + i, docs[11][1]) for i in range(60)]            # a group of copies: ties
    queries = list(enumerate(_texts(2, 30, most=12)))
    queries += [(30, None), (31, ""), (32, "nowhere"), (33, docs[11][1]), (33, docs[11][1]), (None, "w1 w1 W1")]
    got = ranked(spark, [(*d, "x", "y") for d in docs], [(*q, "z", 1) for q in queries], tmp_path / "i")
    assert got == plain_search(docs, queries, 10)


def test_query_sets_and_key_types(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SET_QUERIES", 4)
    docs = list(enumerate(_texts(3, 80)))
    queries = [(f"q{i}", x) for i, x in enumerate(_texts(4, 15, most=9))]
    got = ranked(spark, [(*d, "x", "y") for d in docs], [(*q, "z", 1) for q in queries], tmp_path / "i", 3, "string")
    assert got == plain_search(docs, queries, 3)


def test_no_rows(spark, tmp_path):
    assert ranked(spark, [], [(1, "w1", "", 1)], tmp_path / "a") == []
    assert ranked(spark, [(1, "w1", "", "")], [], tmp_path / "b") == []


def test_a_task_holds_one_block_of_a_large_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lexical, "BATCH_BYTES", 500)
    docs = list(enumerate(x + " w0" for x in _texts(6, 70)))
    queries = list(enumerate(_texts(7, 9, most=9)))
    blocks = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), str(tmp_path / "i"))
    file, = (tmp_path / "i").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1] * 10

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    assert [r.n for r in blocks.coalesce(1).mapInArrow(sizes, "n long").collect()] == [1] * 10
    found = lexical.search(blocks, spark.createDataFrame(queries, "item_id long, text string"), 5).collect()
    assert sorted(map(tuple, found), key=repr) == plain_search(docs, queries, 5)


def test_slices_of_a_long_text(monkeypatch):
    text = " ".join(["ab", "Cd9", "é" * 40, "x"] * 50) + "  !"
    monkeypatch.setattr(lexical, "SLICE", 16)
    parts = [t.decode() for p in lexical.slices(text) for t in p]
    assert parts == plain_terms(text)


def test_bounds_prune(prose):
    """Far fewer documents are scored than hold a term."""
    rng = np.random.default_rng(5)
    n = 20_000
    lists = []
    for share in (0.5, 0.3, 0.2, 0.02, 0.01):
        docs = np.flatnonzero(rng.random(n) < share)
        lists.append((docs, (rng.integers(50, 100, len(docs)) / share).astype(np.int64)))
    lists[4] = (np.union1d(lists[4][0], lists[3][0][:12]), np.full(len(np.union1d(lists[4][0], lists[3][0][:12])), 9000))
    postings, best = lexical.Postings(lists, np.arange(n), 0), lexical.Best(10)
    scored = postings.search(np.arange(5), best)
    total = np.zeros(n, np.int64)
    for d, i in lists:
        total[d] += i
    by = np.lexsort((np.arange(n), -total))[:10]
    assert best.keys.tolist() == by.tolist() and best.scores.tolist() == total[by].tolist()
    assert scored < (total > 0).sum() / 5
