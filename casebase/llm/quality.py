"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a look-up table over its quantile bins.  The tables are
learned by cyclic boosting: round after round, for one feature after the other, a
tree of at most three leaves is fitted to the gradient and added to that
feature's table with a small step.  Then the pairs of features with the largest
gain on what is left get tables of their own from shallow two-feature trees.  A
score is the sigmoid of the added table entries of a row's bins.

Features come from the text alone.  The model is fitted on a sample of at most
about ``fit_rows`` labelled rows (a documented bound, drawn by key hash); whole
texts are scored.

Defined cases: a NULL text is read as an empty one, and empty texts get the
score of their bins; labels other than 0 and 1 are not used, nor are documents
with labels of both kinds; with labels of one kind only, or none, every score is
that label (1 without labels: nothing was learned against a document); repeated
rows are repeated; an empty table gives an empty result; columns named like the
result's are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import bounded_sample, release, worker_state

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "symbols", "stops",
    "bars", "shouts", "non_ascii", "spaces", "types", "top_word", "echo", "lines", "line_length",
    "repeated_lines", "short_words", "pair_types", "marked_words", "controls")
_CLASS = {name: np.zeros(256, dtype=bool) for name in
          ("upper", "lower", "digit", "symbol", "stop", "bar", "shout", "high", "space", "control")}
for _b in range(256):
    _c = chr(_b)
    _CLASS["high"][_b] = _b >= 128
    if _b < 128:
        _CLASS["upper"][_b], _CLASS["lower"][_b] = _c.isupper(), _c.islower()
        _CLASS["digit"][_b], _CLASS["space"][_b] = _c.isdigit(), _c.isspace()
        _CLASS["symbol"][_b] = _c in "#$%&*+/<=>@\\^_`{}~[]"
        _CLASS["stop"][_b], _CLASS["shout"][_b] = _c in ".,;:", _c in "!?"
        _CLASS["bar"][_b] = _c in "|"
        _CLASS["control"][_b] = _b < 32 and not _c.isspace() or _b == 127
_KINDS = np.array([_CLASS[x] for x in _CLASS], dtype=np.int64).T       # byte x class


def text_features(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    upper, lower, digit, symbol, stop, bar, shout, high, space, control = (
        np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS).tolist()
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    chars = sum(map(len, words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), chars / m, (upper + lower + high) / n,
        upper / max(1, upper + lower), digit / n, symbol / n, stop / m, bar / m, shout / m,
        high / n, space / n, len(seen) / m, max(seen.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m, np.log1p(len(lines)), np.log1p(len(text) / k),
        1 - len(set(lines)) / k if lines else 0.0,
        sum(c for w, c in seen.items() if len(w) <= 3) / m,
        len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
        sum(c for w, c in seen.items() if not w[-1].isalnum()) / m, control / n]


class Gam:
    """Bin edges, one table a feature, one table a chosen pair, and a constant."""

    def __init__(self, edges, bias, tables, pairs, coarse):
        self.edges, self.bias, self.tables = edges, bias, tables
        self.pairs, self.coarse = pairs, coarse       # coarse[f]: bin -> bin of the pair tables

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right")
                         for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(x) == 0:
            return np.zeros(0)
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for (f, g), t in self.pairs.items():
            total += t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Steps of a shallow tree over ordered bins with gradient ``g`` and weight ``h``."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-12, None)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            left = cg[:-1] ** 2 / (ch[:-1] + smooth)
            right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + smooth)
            gain = left + right - cg[-1] ** 2 / (ch[-1] + smooth)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], lo + i + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + smooth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """(gain, steps) of one cut of the first feature and one of the second on either side."""
    part = lambda a, b: a ** 2 / (b + smooth)
    best = (-1.0, None)
    for i in range(1, len(g)):
        gain, step = 0.0, np.empty_like(g)
        for rows in (slice(0, i), slice(i, None)):
            cg, ch = np.cumsum(g[rows].sum(axis=0)), np.cumsum(h[rows].sum(axis=0))
            both = part(cg[:-1], ch[:-1]) + part(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            j = int(both.argmax())
            gain += both[j]
            step[rows, :j + 1] = cg[j] / (ch[j] + smooth)
            step[rows, j + 1:] = (cg[-1] - cg[j]) / (ch[-1] - ch[j] + smooth)
        if gain > best[0]:
            best = (gain, step)
    return best[0] - part(g.sum(), h.sum()), best[1]


def train(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 200, leaves: int = 3,
          rate: float = 0.1, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60,
          smooth: float = 5.0) -> Gam:
    """Cyclic boosting of single-feature tables, then of the best pairs."""
    n, k = x.shape
    if n == 0 or y.min() == y.max():
        sure = 30.0 if n == 0 or y[0] == 1 else -30.0
        return Gam([np.zeros(0)] * k, sure, [np.zeros(1)] * k, {}, [np.zeros(1, int)] * k)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    model = Gam(edges, float(np.log(y.mean() / (1 - y.mean()))),
                [np.zeros(len(e) + 1) for e in edges], {}, None)
    b = model.bins(x)
    total = np.full(n, model.bias)
    slopes = lambda: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-total)))
    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            size = len(edges[f]) + 1
            step = rate * _tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size),
                                leaves, smooth)
            model.tables[f] += step
            total += step[b[:, f]]
    model.coarse = [np.arange(len(e) + 1) * pair_bins // (len(e) + 1) for e in edges]
    c = np.stack([model.coarse[f][b[:, f]] for f in range(k)], axis=1)
    grid = pair_bins * pair_bins

    def pair_step(f, q, g, h):
        cell = c[:, f] * pair_bins + c[:, q]
        return _pair_tree(np.bincount(cell, g, grid).reshape(pair_bins, -1),
                          np.bincount(cell, h, grid).reshape(pair_bins, -1), smooth)
    g, h = slopes()
    ranked = sorted(((-pair_step(f, q, g, h)[0], f, q) for f in range(k) for q in range(f + 1, k)))
    for _, f, q in ranked[:pairs]:
        model.pairs[f, q] = np.zeros((pair_bins, pair_bins))
    for _ in range(pair_rounds):
        for (f, q), table in model.pairs.items():
            g, h = slopes()
            step = rate * pair_step(f, q, g, h)[1]
            table += step
            total += step[c[:, f], c[:, q]]
    return model


def _features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t.as_py()) for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))],
                                             [*keep, "x"])
    src = docs.select(*keep, F.col(text).alias("_text"))
    return src.mapInArrow(run, docs.select(*keep).schema.add("x", T.ArrayType(T.DoubleType())))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
        label: str = "quality", fit_rows: int = 20_000, **options) -> Gam:
    """Fit on the labelled documents (the caller leaves out held-out keys of ``labels``)."""
    ship_package(docs.sparkSession)
    clean = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
             .groupBy(F.col(key).alias("_k"))
             .agg(F.min(label).alias("y"), F.max(label).alias("_max")).where("y = _max").drop("_max"))
    sample = bounded_sample(clean, "_k", fit_rows)         # at most 2 * fit_rows keys
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_x")).join(
        F.broadcast(sample), "_k")
    # one row a key, should documents repeat a key
    one = _features(rows, "_x", ["_k", "y"]).groupBy("_k").agg(F.min(F.struct("x", "y")).alias("r"))
    got = sorted((tuple(r.x), r.y) for r in one.select("r.*").collect())
    x = np.array([v for v, _ in got], dtype=np.float64).reshape(-1, len(FEATURES))
    return train(x, np.array([v for _, v in got], dtype=np.float64), **options)


def score_of(model: Gam, text: Column) -> Column:
    """The score of a text.  Tasks get the texts alone; the other columns of a row stay where they are."""
    spark = SparkSession.getActiveSession()
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_state("quality")
        for b in batches:
            x = np.array([text_features(t.as_py()) for t in b], dtype=np.float64)
            yield pa.array(sent.value.score(x.reshape(-1, len(FEATURES))))
        release()
    return F.arrow_udf(run, "double")(text)


def score(docs: DataFrame, model: Gam, *, text: str = "text", threshold: float = 0.7,
          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) with ``score`` and ``predicted``, which replace columns
    of the same names."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    p = score_of(model, docs[text])
    return docs.select(*names, p.alias("score"), (p >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Gam, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, as they are."""
    return docs.where(score_of(model, docs[text]) >= threshold)
