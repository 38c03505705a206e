"""Learned partitions: recall against brute force, exact scores, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebase.llm import ann


def brute(rows, queries, k):
    """(query, rank, id, score) by comparing everything."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in {i: a for i, a in ok if queries(i)}.items():
        near = {}
        for i, b in ok:
            if i != q and len(a) == len(b):
                near[i] = min(near.get(i, np.inf), float(np.sqrt(((a - b) ** 2).sum())))
        best = sorted(near.items(), key=lambda x: (x[1], x[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(best)]
    return out


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16)) * 2
    x = centre[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, k=10, parts=16, fit_rows=2000, block=700,
                     query_block=40).collect()
    want = brute(rows, lambda i: i % 50 == 0, 10)
    assert len(got) == len(want) == 1200
    found = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, i, s) for q, _, i, s in want if (q, i) in found]
    assert len(hits) / len(want) >= 0.9
    assert all(found[q, i] == pytest.approx(s, rel=1e-12) for q, i, s in hits)
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)


def test_router_visits_few_parts():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(16, 8))[rng.integers(0, 16, 3000)] * 5 + rng.normal(size=(3000, 8)) * 0.3
    router = ann.fit(x, parts=16)
    assert router.probes < 8
    size = np.bincount(router.logits(x).argmax(1), minlength=16)
    assert size.max() < 3000 / 3


def test_parts_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 4))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 5), 8, rng)
    assert part.min() >= 0 and np.bincount(part, minlength=8).max() <= np.ceil(1.1 * 1000 / 8)


def test_odd_vectors_ties_and_repeats(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, []), (8, [2.0, 0.0]), (9, [0.0, 0.0, 1.0]), (10, [0.0, 0.0, 3.0]),
            (20, [0.0, 1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (30, [1.0, 0.0]), (30, [1.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score)
                 for r in ann.search(df, F.col("vec_id") % 10 == 0, k=3).collect())
    assert got == sorted(brute(rows, lambda i: i % 10 == 0, 3))
    assert [g[2] for g in got if g[0] == 0] == [1, 30, 8] and not any(g[0] == 20 for g in got)
    empty = df.where(F.lit(False))
    assert ann.search(empty, F.col("vec_id") % 10 == 0).count() == 0


def test_one_vector_holds_a_third(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(800, 6)), np.ones((400, 6))])
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(
        df, F.col("vec_id") >= 1195, k=5, parts=8, block=50, query_block=2).collect()}
    assert got == {(q, r): i for q, r, i, _ in brute(rows, lambda i: i >= 1195, 5)}


def test_components_of_any_size(spark):
    rows = [(0, [1e160, 0.0]), (1, [1.5e160, 1e159]), (2, [-1e160, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.5]),
            (5, [1e-170, 0.0]), (6, [3e-170, 0.0]), (7, [1e308, 0.0]), (8, [-1e308, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.lit(True), k=3).collect()
    assert len(got) == 27
    score = {(r.query_id, r.vec_id): r.score for r in got}
    assert score[3, 4] == 0.5 and score[5, 6] == pytest.approx(2e-170, rel=1e-12)
    assert score[0, 1] == pytest.approx(np.hypot(0.5e160, 1e159), rel=1e-12)
    assert {r.vec_id for r in got if r.query_id == 7} == {0, 1, 2} and min(
        r.score for r in got if r.query_id == 7) < float("inf")


def test_a_query_in_a_tiny_part_gets_k_rows(spark, monkeypatch):
    """Only three vectors lie in the part that their queries visit."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(600, 4)), 50 + rng.normal(size=(3, 4))])

    def two_parts(sample, **_):
        w = np.zeros((4, 2))
        w[0, 1] = 1.0
        return ann.Router(np.full(4, 20.0), np.ones(4), np.eye(4), np.zeros(4), w, np.array([0.5, 0.0]), 1)
    monkeypatch.setattr(ann, "fit", two_parts)
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(df, F.col("vec_id") >= 599, k=5).collect()}
    assert got == {(q, r): i for q, r, i, _ in brute(rows, lambda i: i >= 599, 5)}
