"""Approximate nearest neighbours by learned partitions.

Fit, on a sample of at most about ``fit_rows`` vectors (a documented bound): the
sample's neighbour graph is cut into balanced parts (balanced seeds, then moves to the part
with most of a vertex' neighbours while it has room), and a small neural classifier
learns which parts hold a vector's neighbours.  Every vector of the table is indexed
under the classifier's most probable part; a query is routed to several most probable
parts, and all their vectors are reranked by the exact distance in double precision.
The number of parts that a query visits is the smallest one with which the sample's own
queries find at least ``target`` of their true neighbours.

Routed queries meet the vectors of a part in blocks (vector blocks x query
blocks, sized from the counts of each part), so neither a part with a
third of all rows nor a vector that a third of all rows repeat lands in one task,
and only the k best of each block leave it.

Defined cases: NULL vectors, empty or zero ones and those with NULL or non-finite
components take no part; vectors of another length than the most frequent
one are searched exhaustively among those of their own length; a query with no candidate
has no result rows; a row's own id is never its neighbour, nor are rows that repeat that id;
repeated queries are answered once; ties go to the smaller id; an empty
table gives an empty result; other columns are ignored.  A query whose parts hold fewer than k others is
searched in all parts.  There are at most k + 1 such queries a part: every query is itself
indexed in its first part.  Components of any finite size are compared without overflow, the distance itself
is infinite only where it exceeds a double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .common import bounded_sample


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v array<double>, dim)`` of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.where(F.col(key).isNotNull() & F.coalesce(
        finite & F.exists(v, lambda x: x != 0.0), F.lit(False)))
        .select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")))


def _stack(col: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def tame(x: np.ndarray) -> np.ndarray:
    """Whether squares of numbers up to ``x`` stay within the doubles."""
    return (x == 0) | ((x > 1e-140) & (x < 1e140))


def unit_of(x: np.ndarray) -> float:
    """A power of two that brings the largest component to about 1 if it isn't tame, else 1."""
    big = np.abs(x).max() if x.size else np.float64(0)
    return 1.0 if tame(big) else float(2.0 ** -np.clip(np.frexp(big)[1], -1000, 1000))


def distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Euclidean distance of every row of ``v`` from ``q``."""
    with np.errstate(over="ignore"):
        diff = v - q
        out = np.sqrt((diff ** 2).sum(axis=1))
        odd = ~tame(np.abs(diff).max(axis=1))
        if odd.any():
            half = v[odd] / 2 - q / 2                     # of halves, no difference overflows
            shift = np.frexp(np.abs(half).max(axis=1))[1]
            root = np.sqrt((np.ldexp(half, -shift[:, None]) ** 2).sum(axis=1))
            out[odd] = np.ldexp(root, shift + 1)
    return out


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest rows of every row, itself left out."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for at in range(0, n, 1024):
        d = squares(x[at:at + 1024], x)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable")
        out[at:at + 1024] = np.take_along_axis(near, order, axis=1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, m: int, rng, slack: float = 0.1,
                   rounds: int = 15) -> np.ndarray:
    """The part of every vertex: few cut edges, no part over (1 + slack) n / m vertices."""
    n = len(x)
    room = int(np.ceil((1 + slack) * n / m))
    centre = x[rng.choice(n, m, replace=False)]
    for _ in range(8):
        own = squares(x, centre).argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.bincount(own, minlength=m)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    d = squares(x, centre)
    part, size = np.full(n, -1), np.zeros(m, np.int64)
    best = np.argsort(d, axis=1)
    for i in np.argsort(d.min(1)):                       # sure vertices first
        for p in best[i]:
            if size[p] < room:
                part[i], size[p] = p, size[p] + 1
                break
    edges = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1),
                            np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.zeros((n, m), np.int32)
        np.add.at(votes, (edges[:, 0], part[edges[:, 1]]), 1)
        to = votes.argmax(1)
        gain = votes[np.arange(n), to] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[to[i]] < room:
                size[part[i]] -= 1
                part[i], moved = to[i], moved + 1
                size[to[i]] += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer; probabilities of the parts."""

    def __init__(self, mean, scale, w1, b1, w2, b2, probes: int, unit: float = 1.0):
        self.mean, self.scale, self.probes, self.unit = mean, scale, probes, unit
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):       # far beyond the sample: any part will do
            h = np.maximum((x * self.unit - self.mean) / self.scale @ self.w1 + self.b1, 0.0)
            return np.nan_to_num(h @ self.w2 + self.b2)


def train_router(x: np.ndarray, target: np.ndarray, rng, hidden: int = 128, epochs: int = 40,
                 batch: int = 256, rate: float = 2e-3) -> Router:
    """Softmax classifier of the target distributions, by Adam."""
    d, m = x.shape[1], target.shape[1]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    params = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden),
              rng.normal(0, np.sqrt(1 / hidden), (hidden, m)), np.zeros(m)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            i = order[at:at + batch]
            a = z[i] @ params[0] + params[1]
            h = np.maximum(a, 0.0)
            o = h @ params[2] + params[3]
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            e = (p - target[i]) / len(i)
            back = (e @ params[2].T) * (a > 0)
            grads = [z[i].T @ back + 1e-5 * params[0], back.sum(0),
                     h.T @ e + 1e-5 * params[2], e.sum(0)]
            t += 1
            for j, g in enumerate(grads):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                params[j] -= rate * (first[j] / (1 - 0.9 ** t)) / (
                    np.sqrt(second[j] / (1 - 0.999 ** t)) + 1e-8)
    return Router(mean, scale, *params, probes=1)


def fit(x: np.ndarray, *, k: int = 10, parts: int = 32, target: float = 0.97,
        seed: int = 5) -> Router:
    """Learn the parts and the router from the sample ``x`` (one row a vector)."""
    rng = np.random.default_rng(seed)
    unit = unit_of(x)
    x = x * unit
    m = max(1, min(parts, len(x) // 50))
    if m == 1:
        d = x.shape[1]
        return Router(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)),
                      np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    part = balanced_parts(x, graph, m, rng)
    goal = np.zeros((len(x), m))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    np.add.at(goal, (np.arange(len(x)), part), 1.0)
    goal /= goal.sum(1, keepdims=True)
    # calibrate on vectors that the router has not seen, then learn from all
    test = rng.permutation(len(x))[:min(1000, len(x) // 5)]
    seen = np.setdiff1d(np.arange(len(x)), test)
    trial = train_router(x[seen], goal[seen], rng)
    ranked = np.argsort(-trial.logits(x), axis=1, kind="stable")
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(m)[None, :].repeat(len(x), 0), axis=1)
    need = place[test[:, None], ranked[graph[test], 0]]      # the visit that finds each neighbour
    found = np.bincount(need.ravel(), minlength=m).cumsum() / need.size
    router = train_router(x, goal, rng)
    router.probes = int(np.searchsorted(found, target)) + 1
    router.probes = min(m, router.probes + 1)
    router.unit = unit
    return router


def _routed(rows: DataFrame, router: Router | None, dim: int, probes: int) -> DataFrame:
    """``rows`` with the array ``parts``: the most probable ones, or that of an odd length."""
    odd = F.array(-F.col("dim"))
    if router is None:
        return rows.withColumn("parts", odd)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            ranked = np.argsort(-sent.value.logits(_stack(b.column(1))), axis=1,
                                kind="stable")[:, :probes].astype(np.int32)
            parts = pa.ListArray.from_arrays(
                np.arange(0, ranked.size + 1, ranked.shape[1], dtype=np.int32), ranked.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, parts], ["id", "v", "dim", "parts"])

    main = rows.where(F.col("dim") == dim).mapInArrow(
        run, "id long, v array<double>, dim int, parts array<int>")
    return main.union(rows.where(F.col("dim") != dim).withColumn("parts", odd))


def _distinct(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows without equal ones, and how many rows an id has at most."""
    names, count = np.unique(ids, return_counts=True)
    if len(names) == len(ids):
        return ids, v, 1
    often = set(names[count > 1].tolist())
    seen: set = set()
    keep = np.ones(len(ids), bool)
    for i in np.flatnonzero(np.isin(ids, list(often))):
        row = (int(ids[i]), v[i].tobytes())
        keep[i] = row not in seen
        seen.add(row)
    return ids[keep], v[keep], int(np.unique(ids[keep], return_counts=True)[1].max())


def best_of(query_id, q, vec_id, v, k: int):
    """``(query_id, vec_id, score)`` of each query's k nearest vectors of a block, exactly."""
    out: list[list[np.ndarray]] = [[], [], []]
    vec_id, v, most = _distinct(vec_id, v)
    step = max(1, 4_000_000 // max(1, len(v)))
    plain = all(tame(np.abs(m).max()) for m in (q, v) if m.size)
    for at in range(0, len(q), step):
        # where squares could overflow, all of the block are ranked by their exact distance
        d = squares(q[at:at + step], v) if plain else np.zeros((len(q[at:at + step]), len(v)))
        d[query_id[at:at + step][:, None] == vec_id[None, :]] = np.inf
        kk = min(k * most, d.shape[1])
        kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        # the quick distances round differently: keep all within their error, rank exactly
        big = (q[at:at + step] ** 2).sum(1) + (v ** 2).sum(1).max() if plain else np.zeros(len(d))
        for i, row in enumerate(d):
            near = np.flatnonzero(row <= kth[i] + 1e-12 * big[i]) if np.isfinite(kth[i]) \
                else np.flatnonzero(np.isfinite(row))
            exact = distances(v[near], q[at + i])
            first = np.lexsort((vec_id[near], exact))
            place = np.unique(vec_id[near][first], return_index=True)[1]
            top = np.sort(place)[:k]                     # an id counts once
            out[0].append(np.full(len(top), query_id[at + i]))
            out[1].append(vec_id[near][first][top])
            out[2].append(exact[first][top])
    return [np.concatenate(x) if x else np.zeros(0) for x in out]


def search(vectors: DataFrame, queries, *, key: str = "vec_id", vector: str = "embedding",
           k: int = 10, parts: int = 32, fit_rows: int = 8_000, target: float = 0.97,
           block: int = 20_000, query_block: int = 2_000) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every row for which the
    column ``queries`` holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    queries = F.coalesce(queries, F.lit(False))
    rows = usable(vectors, key, vector)
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    router, dim = None, -1
    if dims is not None:
        dim = dims.dim
        sample = bounded_sample(rows.where(F.col("dim") == dim), "id", fit_rows)
        got = sample.select("id", "v").toArrow().sort_by("id")
        router = fit(_stack(got.column("v").combine_chunks()), k=k, parts=parts, target=target)
    probes = router.probes if router else 1
    index = cut_lineage(_routed(rows, router, dim, 1).select(
        "id", "v", F.col("parts")[0].alias("part")))
    asked = cut_lineage(_routed(usable(vectors.where(queries), key, vector).dropDuplicates(["id"]),
                                router, dim, probes)
                        .select("id", "v", F.explode("parts").alias("part")))
    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            a, b = a.combine_chunks(), b.combine_chunks()
            cols = best_of(a["id"].to_numpy(), _stack(a["v"].combine_chunks()),
                           b["id"].to_numpy(), _stack(b["v"].combine_chunks()), k)
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    def nearest(asked: DataFrame) -> DataFrame:
        """The k best of every query in the parts that it is asked of."""
        # the blocks of a part, from the counts of its vectors and queries (a row a part)
        grid = (index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
                .join(asked.groupBy("part").agg(F.count(F.lit(1)).alias("q")), "part")
                .select("part", F.ceil(F.col("n") / block).cast("int").alias("vb"),
                        F.ceil(F.col("q") / query_block).cast("int").alias("qb")))
        spread = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
        pick = lambda by: F.pmod(F.xxhash64("id"), F.col(by)).cast("int")
        left = asked.join(grid, "part").select("part", spread("vb").alias("b"), pick("qb").alias("c"),
                                               "id", "v")
        right = index.join(grid, "part").select("part", pick("vb").alias("b"), spread("qb").alias("c"),
                                                "id", "v")
        met = (left.groupBy("part", "b", "c").cogroup(right.groupBy("part", "b", "c"))
               .applyInArrow(meet, "query_id long, vec_id long, score double"))
        return ranked(met)

    def ranked(met: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return (met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
                .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    found = cut_lineage(nearest(asked))
    m = router.w2.shape[1] if router else 1
    if probes < m:                                        # queries whose parts hold fewer than k others
        got = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        few = (asked.where("part >= 0").dropDuplicates(["id"]).join(got, "id", "left")
               .where(F.coalesce("n", F.lit(0)) < k)
               .select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("part")))
        few = cut_lineage(few)
        if few.limit(1).count():
            found = ranked(found.drop("rank").unionByName(nearest(few).drop("rank")))
    return found
