"""The search in cells equals the plain search, with ties, NULLs, keys and hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebase import CaseModel, FeatureSpec
from casebase.operators.bounded import bounded_topk
from casebase.operators.topk import blocked_topk


def _table(spark, n, seed, start=0, reps=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = None if i % 37 == 0 else float(rng.integers(0, 40)) / 4
        y = float("nan") if i % 53 == 0 else float(np.round(rng.normal(), 1))
        rows.append((start + i, "abcd"[int(rng.integers(0, 4))] if i % 29 else None,
                     "hot" if i % 3 else f"v{i % 7}", x, y, "PQN"[int(rng.integers(0, 3))], i % reps))
    return spark.createDataFrame(
        rows, "id long, f1 string, f2 string, x double, y double, label string, rep int")


def _both(model, left, right, by=(), exclude=None, k=7, cell_rows=20):
    options = dict(left_key=["query_id"], right_key=["case_id"], k=k, kernel=model.metric.kernel,
                   attach=model.metric.attach, exclude_self=exclude, left_payload={"label": "label"},
                   right_payload={"case_label": "label"})
    cols = [*by, "query_id", "rank", "case_id", "distance", "label", "case_label"]
    rows = lambda df: sorted(map(str, df.select(cols).collect()))
    a = rows(blocked_topk(left, right, eq=list(by), **options))
    return a, rows(bounded_topk(left, right, eq=list(by), cell_rows=cell_rows, **options))


@pytest.mark.parametrize("numbers", [("x",), ("x", "y")])
def test_like_plain_search(spark, numbers):
    spec = FeatureSpec("id", "label", ("f1", "f2"), numbers)
    train, test = _table(spark, 1500, 1), _table(spark, 200, 2, 10_000)
    m = CaseModel.fit(train, spec)
    a, b = _both(m, test.withColumnRenamed("id", "query_id"), m.cases.withColumnRenamed("id", "case_id"))
    assert a == b and len(a) == 1400


def test_leave_self_out_and_repetitions(spark):
    spec = FeatureSpec("id", "label", ("f2",), ("x",))
    train = _table(spark, 900, 3, reps=3)
    m = CaseModel.fit(train, spec, by=["rep"])
    a, b = _both(m, m.cases.withColumnRenamed("id", "query_id"), m.cases.withColumnRenamed("id", "case_id"),
                 by=["rep"], exclude=("query_id", "case_id"), cell_rows=40)
    assert a == b and len(a) == 6300


def test_fewer_rows_than_k_and_one_value(spark):
    spec = FeatureSpec("id", "label", ("f2",), ("x",))
    same = spark.range(300).select("id", F.lit("a").alias("f2"), F.lit(1.0).alias("x"), F.lit("P").alias("label"))
    m = CaseModel.fit(same, spec)                         # no spread
    left = same.limit(9).withColumnRenamed("id", "query_id")
    a, b = _both(m, left, same.withColumnRenamed("id", "case_id"), cell_rows=10)
    assert a == b and len(a) == 63
    few = same.limit(4)
    a, b = _both(CaseModel.fit(few, spec), left, few.withColumnRenamed("id", "case_id"), cell_rows=100)
    assert a == b


def test_sends_queries_to_few_cells(spark):
    from casebase.operators import bounded
    spec = FeatureSpec("id", "label", ("f2",), ("x",))
    rng = np.random.default_rng(5)
    rows = [(i, f"v{i % 4}", float(v), "PN"[i % 2]) for i, v in enumerate(rng.uniform(0, 1, 4000))]
    cases = spark.createDataFrame(rows, "id long, f2 string, x double, label string")
    m = CaseModel.fit(cases, spec)
    right = m.metric.attach(cases.withColumnRenamed("id", "case_id"))
    cells = bounded.cells_of(right, m.metric.kernel, [], ["case_id"], 50, 4000)
    summary = bounded.summaries(cells, m.metric.kernel, [])
    left = m.metric.attach(cases.limit(100).withColumnRenamed("id", "query_id")).withColumn("_t", F.lit(0.02))
    pairs = bounded._route(left, summary, m.metric.kernel, [], ["query_id"], 5, 1, 1, "_t")
    assert 100 <= pairs.count() < 100 * 20 and cells.select("_cell").distinct().count() >= 80


def test_summaries_in_parts(spark, monkeypatch):
    from casebase.operators import bounded
    monkeypatch.setattr(bounded, "SUMMARY_ROWS", 9)
    monkeypatch.setattr(bounded, "QUERY_ROWS", 60)
    spec = FeatureSpec("id", "label", ("f2",), ("x",))
    train, test = _table(spark, 1500, 1), _table(spark, 200, 2, 10_000)
    m = CaseModel.fit(train, spec)
    a, b = _both(m, test.withColumnRenamed("id", "query_id"), m.cases.withColumnRenamed("id", "case_id"), cell_rows=30)
    assert a == b and len(a) == 1400


def test_rules_in_cells(spark, monkeypatch):
    """Rule retrieval through range cells of change vectors gives the rules of the plain search."""
    from casebase.operators import bounded
    from casebase.operators.classify import adapt_classify
    spec = FeatureSpec("id", "label", ("f2",), ("x", "y"))
    train, test = _table(spark, 500, 4), _table(spark, 60, 5, 10_000)
    m = CaseModel.fit(train, spec, radius=6)
    rows = lambda: sorted(map(str, adapt_classify(test, m, 4, 5).collect()))
    plain = rows()
    used = []
    routed = bounded.bounded_topk
    monkeypatch.setattr(bounded, "BOUNDED_ROWS", 600)
    monkeypatch.setattr(bounded, "CELL_ROWS", 32)
    monkeypatch.setattr(bounded, "bounded_topk", lambda *a, **o: used.append(1) or routed(*a, **o))
    assert rows() == plain and len(plain) == 60 and used == [1]


class _Sum:
    n = 0

    def add(self, x):
        self.n += x


def _block(cats, nums, n_left=600, n_right=6000, values=6, clusters=False):
    """Two sides with NULLs, NaNs, unseen values and a constant number."""
    import json

    import pandas as pd

    from casebase.functions.kernels import Kernel
    centres = np.random.default_rng(9).normal(size=(12, max(nums, 1))) * 3

    def side(n, seed):
        rng, out = np.random.default_rng(seed), {}
        of = rng.integers(0, 12, n)
        for i in range(cats):
            v = [None if x == 0 and rng.random() < 0.3 else f"v{x}" for x in rng.integers(0, values, n)]
            counts = {f"v{x}": json.dumps({str(c): int(z) for c, z in enumerate(
                np.random.default_rng(x + 100 * i).integers(1, 50, 5))}) for x in range(values)} | {"v1": None}
            out[f"c{i}"], out[f"_v_c{i}"] = np.array(v, object), [counts.get(x) for x in v]
        for i in range(nums):
            x = centres[of, i] + rng.normal(size=n) * 0.05 if clusters else rng.normal(size=n).round(2)
            x[rng.random(n) < 0.02] = np.nan
            out[f"n{i}"], out[f"_s_n{i}"] = x, np.full(n, 0.0 if i == 2 and nums == 3 else 2.0)
        return pd.DataFrame(out, index=range(n))
    kinds = {f"c{i}": "cat" for i in range(cats)} | {f"n{i}": "num" for i in range(nums)}
    return Kernel(tuple(kinds), kinds).block(side(n_left, 1), side(n_right, 2))


@pytest.mark.parametrize("cats, nums, clusters, most", [
    (2, 1, False, 0.3), (3, 0, False, 0.5), (0, 2, False, 0.8), (2, 3, False, 2), (1, 5, True, 2),
    (0, 16, True, 0.9), (0, 16, False, 2), (1, 1, False, 0.3)])
def test_cells_of_a_block(monkeypatch, cats, nums, clusters, most):
    """The k nearest by cells (ranges, or pivots with many numbers) are those of all distances."""
    from casebase.functions import kernels as K
    monkeypatch.setattr(K, "LEAST", 1000)
    block = _block(cats, nums, clusters=clusters)
    n = block.n_right
    for exclude in (False, True):
        def hide(d, rows, cols, exclude=exclude):
            return np.where(rows[:, None] == cols[None, :], np.inf, d) if exclude else d
        looked = _Sum()
        got = [np.concatenate(x) for x in zip(*block.nearest(9, hide, None, looked), strict=True)]
        every = np.concatenate([block.distances(i, i + 1) for i in range(block.n_left)])
        want = K.topk_per_row(hide(every, np.arange(block.n_left), np.arange(n)), 9)
        order = np.lexsort((got[3], got[0]))
        assert all((g[order] == w).all() for g, w in zip(got, want, strict=True))
        assert looked.n < most * block.n_left * n
    limit = np.quantile(every, 0.001, axis=1)
    within = [np.concatenate(x) for x in zip(*block.nearest(9, lambda d, r, c: d, limit), strict=True)]
    got = K.topk_per_row(every, 9)
    keep = got[2] <= limit[got[0]]
    order = np.lexsort((within[3], within[0]))
    assert (within[1][order] == got[1][keep]).all() and (within[2][order] == got[2][keep]).all()


@pytest.mark.parametrize("nums, kind", [
    (16, "plain"), (4, "plain"), (6, "far"), (6, "copies"), (5, "flat"), (4, "missing")])
def test_screen_of_a_block(monkeypatch, nums, kind):
    """With many numbers most distances are not computed, and the k nearest are those of all distances."""
    from casebase.functions import kernels as K
    monkeypatch.setattr(K, "SCREEN_CELLS", 300_000)
    block, rng = _block(0, nums, n_left=150), np.random.default_rng(4)
    for i in range(nums):
        f = f"n{i}"
        a, b = block.left[f], block.right[f]
        if kind == "far":                  # outliers, an offset far above the spread, infinite queries
            b[rng.integers(0, len(b), 40)] = 1e13 * rng.normal(size=40)
            a[rng.integers(0, len(a), 5)], a[:2] = 1e13, np.inf
            if i == 1:
                a += 1e9
                b += 1e9
        if kind == "copies":
            b[1000:] = b[rng.integers(0, 40, len(b) - 1000)]
            a[:75] = b[:75]
        if kind == "flat" and i < 3:
            b[:], block.sigma[f] = 1.5, [0.0, np.nan, 2.0][i]
        if kind == "missing":
            b[rng.random(len(b)) < 0.4] = np.nan
            a[:30] = np.nan
            if i == 2:
                b[:] = np.nan
    every = np.concatenate([block.distances(i, i + 1) for i in range(block.n_left)])
    screen = K.Screen(block)
    low, base = screen.bounds(np.arange(block.n_left))
    assert (low[:, :block.n_right] + base[:, None] <= every ** 2 + screen.margin).all()
    limit = np.quantile(every, 0.003, axis=1)
    for exclude in (False, True):
        def hide(d, rows, cols, exclude=exclude):
            return np.where(rows[:, None] == cols[None, :], np.inf, d) if exclude else d
        for within in (None, limit):
            looked = _Sum()
            got = [np.concatenate(x) for x in zip(*block.nearest(9, hide, within, looked), strict=True)]
            want = K.topk_per_row(hide(every, np.arange(block.n_left), np.arange(block.n_right)), 9)
            near = np.full(len(want[0]), True) if within is None else want[2] <= within[want[0]]
            order = np.lexsort((got[3], got[0]))
            assert all((g[order] == w[near]).all() for g, w in zip(got, want, strict=True))
            if kind == "plain":
                assert looked.n < 0.5 * block.n_left * block.n_right


def test_many_numbers_like_all_distances(spark):
    """Whole search over several blocks: the spreads come with the left rows only."""
    import pandas as pd

    from casebase.functions.kernels import Kernel
    nums, spread = [f"n{i}" for i in range(6)], 0.7
    kernel = Kernel(tuple(nums), dict.fromkeys(nums, "num"))
    rng = np.random.default_rng(8)
    sides = []
    for key, n in (("q", 150), ("c", 5000)):
        x = rng.normal(size=(n, 6)).round(3)
        x[rng.random((n, 6)) < 0.01] = np.nan
        sides.append(pd.DataFrame(x, columns=nums).assign(**{key: np.arange(n)}))
    left, right = (spark.createDataFrame(s) for s in sides)
    found = blocked_topk(left, right, left_key=["q"], right_key=["c"], k=4, kernel=kernel, right_block_rows=2000,
                         left_block_rows=80,
                         attach=lambda rows: rows.withColumns({f"_s_{f}": F.lit(spread) for f in nums}))
    a, b = (s[nums].to_numpy() for s in sides)
    total = np.zeros((150, 5000))
    for i in range(6):
        total += np.fmin(np.abs(a[:, i, None] - b[None, :, i]) / (4.0 * spread), 1.0)
    d = np.sqrt(total)
    want = [(q, c, d[q, c], i + 1) for q in range(150) for i, c in enumerate(np.argsort(d[q], kind="stable")[:4])]
    assert sorted((r.q, r.c, r.distance, r.rank) for r in found.collect()) == sorted(want)
