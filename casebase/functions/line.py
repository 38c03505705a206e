"""Exact nearest rows under one number and categorical values, by places on number lines.

The right rows of a block lie on one line a combination of categorical values (a profile), in the
order of their numbers.  Within a profile a row's distance grows (weakly, also after rounding) with the
difference of the numbers, so its nearest rows stand around the query's place.  Profiles are visited
by the sum of their categorical terms, until that alone is beyond the k-th distance found.  The
window of a profile is widened while its next row is still within that distance, so ties by rounding, by the
cap of the term or by equal numbers are decided by the key like in the plain search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from .kernels import CHUNK_CELLS, Values, term_table, topk_per_row

FIRST = 4                    # times k: rows of small profiles that are looked at together at first
MOST_ROWS = 4096             # and at last
ROWS = 4096                  # queries that visit a profile together


@dataclass
class LineKernel:
    """``tables``: broadcast ``(vectors, spreads)``: (by key, feature) -> value -> class counts, and by key -> spread."""

    order: tuple
    number: str
    by: tuple
    tables: object

    def block(self, left: pd.DataFrame, right: pd.DataFrame) -> LineBlock:
        return LineBlock(self, left, right)


class Terms:
    """The terms of one categorical feature from a left value to all right values."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, feature: str, known: dict):
        self.left, self.right = (self._values(side, feature, known) for side in (left, right))
        seen = [i for i, v in enumerate(self.left.counts) if v is not None]
        self.at = np.full(len(self.left.distinct) + 1, -1)
        self.at[seen] = np.arange(len(seen))
        own = Values(np.arange(len(seen)), self.left.distinct[seen], [self.left.counts[i] for i in seen])
        self.table = term_table(own, self.right)
        self.same = np.append(pd.Index(self.right.distinct).get_indexer(self.left.distinct), -1)

    @staticmethod
    def _values(side: pd.DataFrame, feature: str, known: dict) -> Values:
        codes, distinct = pd.factorize(side[feature].to_numpy(dtype=object))
        distinct = np.asarray(distinct, object)
        return Values(np.where(codes < 0, len(distinct), codes), distinct, [known.get(v) for v in distinct])

    def row(self, code: int) -> np.ndarray:
        out = self.table[self.at[code]].copy() if self.at[code] >= 0 else np.ones(len(self.right.distinct) + 1)
        if self.same[code] >= 0:
            out[self.same[code]] = 0.0
        return out


def _profiles(codes: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The profile of every row, and the first row of every profile."""
    of = np.zeros(n, dtype=np.int64)
    for c in codes:
        of = np.unique(of * (int(c.max()) + 1) + c, return_inverse=True)[1]
    _, first, of = np.unique(of, return_index=True, return_inverse=True)
    return of, first


class LineBlock:
    """Queries and the right rows of a block, these in the order of their keys (``nearest`` as ``kernels.Block``)."""

    def __init__(self, kernel: LineKernel, left: pd.DataFrame, right: pd.DataFrame):
        vectors, spreads = kernel.tables.value
        key = tuple(right[b].iloc[0] for b in kernel.by)
        self.order, self.number = kernel.order, kernel.number
        self.sigma = spreads.get(key)
        self.flat = self.sigma is None or not np.isfinite(self.sigma) or self.sigma == 0.0
        self.terms = {f: Terms(left, right, f, vectors.get((key, f), {})) for f in self.order if f != self.number}
        self.x = left[self.number].to_numpy(dtype=np.float64)
        self.y = right[self.number].to_numpy(dtype=np.float64)
        self.of, self.first = _profiles([t.left.codes for t in self.terms.values()], len(left))
        self.profile, first = _profiles([t.right.codes for t in self.terms.values()], len(right))
        self.codes = {f: t.right.codes[first] for f, t in self.terms.items()}
        cols = np.lexsort((np.arange(len(right)), self.y, self.profile))       # NaN: behind all
        starts = np.searchsorted(self.profile[cols], np.arange(len(first) + 1))
        self.lengths = np.diff(starts)
        self.lines = [cols[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.numbers = []
        for line in self.lines:
            y = self.y[line]
            self.numbers.append(y[:len(y) - np.count_nonzero(np.isnan(y))])
        self.looked = 0

    def _number(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.where(x == y, 0.0, 1.0)
        with np.errstate(invalid="ignore"):
            return np.fmin(np.abs(x - y) / (4.0 * self.sigma), 1.0)

    def _distance(self, rows: list, number) -> np.ndarray:
        """The terms in the features' order, then the root."""
        acc, rest = 0.0, iter(rows)
        for f in self.order:
            acc = acc + (number if f == self.number else next(rest))
        return np.sqrt(acc)

    def topk(self, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(distances, columns)`` of the ``k`` nearest a query, infinity behind the last one."""
        n = len(self.x)
        best, cols = np.full((n, k), np.inf), np.full((n, k), len(self.y))
        order = np.argsort(self.of, kind="stable")
        ends = np.searchsorted(self.of[order], np.arange(len(self.first) + 1))
        for p, at in enumerate(self.first):
            rows = [t.row(t.left.codes[at])[self.codes[f]] for f, t in self.terms.items()]
            least = self._distance(rows, 0.0) + np.zeros(len(self.lines))
            visits = np.argsort(least, kind="stable")
            for start in range(ends[p], ends[p + 1], ROWS):
                own = order[start:min(start + ROWS, ends[p + 1])]
                limit = np.full(len(own), np.inf) if within is None else within[own]
                best[own], cols[own] = self._search(self.x[own], rows, least, visits, k, limit)
        return best, cols

    def _search(self, x, rows, least, visits, k, limit):
        best, cols = np.full((len(x), k), np.inf), np.full((len(x), k), len(self.y))
        limit, i, size = limit.copy(), 0, FIRST * k
        ahead, sizes = least[visits], np.append(0, np.cumsum(self.lengths[visits]))
        while i < len(visits):
            p, some = visits[i], np.flatnonzero(ahead[i] <= limit)
            if not len(some):
                break
            # small profiles next in the order are looked at together, ever more of them
            last = np.searchsorted(ahead, limit[some].max(), side="right")
            last = min(last, np.searchsorted(sizes, sizes[i] + size, side="right") - 1)
            if last > i:
                self._whole(x, rows, visits[i:last], k, some, best, cols, limit)
                i, size = last, min(2 * size, MOST_ROWS)
                continue
            i += 1
            terms = [r[p] for r in rows]
            known = some[~np.isnan(x[some])]
            gone = some[np.isnan(x[some])]
            if len(gone):
                self._merge(gone, self._distance(terms, np.ones((len(gone), 1))),
                            np.sort(self.lines[p])[:k], best, cols, limit)
            if len(known):
                self._around(x, known, p, terms, k, best, cols, limit, 2 * k)
        return best, cols

    def _merge(self, some, d, c, best, cols, limit):
        """The best of those found and new ones, ties by column."""
        k = best.shape[1]
        c = np.broadcast_to(c, (len(some), c.shape[-1]))
        d = np.concatenate([best[some], np.broadcast_to(d, c.shape)], axis=1)
        c = np.concatenate([cols[some], c], axis=1)
        self.looked += c.size
        take = np.lexsort((c, d), axis=1)[:, :k]
        best[some], cols[some] = np.take_along_axis(d, take, axis=1), np.take_along_axis(c, take, axis=1)
        limit[some] = np.minimum(limit[some], best[some, -1])

    def _around(self, x, some, p, terms, k, best, cols, limit, width):
        """Rows of a line around the queries' places, as far as they can matter."""
        y, line = self.numbers[p], self.lines[p]
        missing = line[len(y):]
        if len(missing):
            self._merge(some, self._distance(terms, np.ones((len(some), 1))), missing[:k], best, cols, limit)
        if not len(y):
            return
        some = self._near(x, some, p, terms, best, cols, limit, 2 * width)
        place = np.searchsorted(y, x[some])
        while len(some):
            step, again = max(1, CHUNK_CELLS // (2 * width)), []
            for at in range(0, len(some), step):
                now, mid = some[at:at + step], place[at:at + step]
                lo, hi = np.maximum(mid - width, 0), np.minimum(mid + width, len(y))
                place_of = lo[:, None] + np.arange(min(2 * width, len(y)))[None, :]
                inside = place_of < hi[:, None]
                place_of = np.minimum(place_of, len(y) - 1)
                d = self._distance(terms, self._number(x[now, None], y[place_of]))
                kept = best[now].copy(), cols[now].copy(), limit[now].copy()
                self._merge(now, np.where(inside, d, np.inf),
                            np.where(inside, line[place_of], len(self.y)), best, cols, limit)
                below = self._distance(terms, self._number(x[now], y[np.maximum(lo - 1, 0)]))
                above = self._distance(terms, self._number(x[now], y[np.minimum(hi, len(y) - 1)]))
                more = ((lo > 0) & (below <= limit[now])) | ((hi < len(y)) & (above <= limit[now]))
                back = np.flatnonzero(more)
                best[now[back]], cols[now[back]], limit[now[back]] = (v[back] for v in kept)
                again.append(at + back)
            again = np.concatenate(again)
            some, place, width = some[again], place[again], width * 4

    def _near(self, x, some, p, terms, best, cols, limit, most):
        """Queries with at most ``most`` rows of a line within their limits look at these rows; returns the others."""
        if self.flat:
            return some
        y, line, least = self.numbers[p], self.lines[p], sum(terms)
        with np.errstate(invalid="ignore", over="ignore"):
            room = limit[some] ** 2 - least
            # a margin far above rounding; with room for the cap of the term every row counts
            r = 4.0 * self.sigma * (room + 1e-9 * (2.0 + least)) + np.abs(x[some]) * 1e-12
            lo, hi = np.searchsorted(y, x[some] - r), np.searchsorted(y, x[some] + r, side="right")
        bounded = (room < 1.0 - 1e-6) & (hi - lo <= most)
        at = np.flatnonzero(bounded & (hi > lo))
        if len(at):
            width = int((hi - lo)[at].max())
            step = max(1, CHUNK_CELLS // width)
            for start in range(0, len(at), step):
                part = at[start:start + step]
                now = some[part]
                place_of = lo[part, None] + np.arange(width)[None, :]
                inside = place_of < hi[part, None]
                place_of = np.minimum(place_of, len(y) - 1)
                d = self._distance(terms, self._number(x[now, None], y[place_of]))
                self._merge(now, np.where(inside, d, np.inf), np.where(inside, line[place_of], len(self.y)),
                            best, cols, limit)
        return some[~bounded]

    def _whole(self, x, rows, profiles, k, some, best, cols, limit):
        """All rows of some profiles."""
        every = np.sort(np.concatenate([self.lines[p] for p in profiles]))
        terms, y = [r[self.profile[every]] for r in rows], self.y[every]
        step = max(1, CHUNK_CELLS // len(every))
        for at in range(0, len(some), step):
            now = some[at:at + step]
            i, j, values, rank = topk_per_row(self._distance(terms, self._number(x[now, None], y[None, :])), k)
            d, c = np.full((len(now), k), np.inf), np.full((len(now), k), len(self.y))
            d[i, rank - 1], c[i, rank - 1] = values, every[j]
            self.looked += len(now) * (len(every) - k)
            self._merge(now, d, c, best, cols, limit)

    def nearest(self, k: int, hide=None, within: np.ndarray | None = None, compared=None):
        """Like ``kernels.Block.nearest``, in one part; nothing is hidden."""
        best, cols = self.topk(k, within)
        found = np.isfinite(best)
        if within is not None:
            found &= best <= within[:, None]
        rows, rank = np.nonzero(found)
        if compared is not None:
            compared.add(self.looked)
        yield rows, cols[rows, rank], best[rows, rank], (rank + 1).astype(np.int32)
