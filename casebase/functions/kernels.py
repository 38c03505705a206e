"""Vectorised distance terms evaluated inside Spark tasks.

These are the per-block helpers of the blocked top-k operator: given a block
of left rows and a block of right rows (pandas, delivered by Arrow), they
return the matrix of distances.  The metric comes with the rows: a categorical
value carries its class counts (``_v_<feature>``, a JSON object label -> count,
NULL for a value never seen in training) and a numeric feature its spread
(``_s_<feature>``), so nothing is collected or broadcast.  The arithmetic follows
the SQL form term by term so results are bit-identical to a plain SQL evaluation:

* categorical: ``0`` if equal; ``vdm^2`` if both values are seen in training, with
  ``vdm = (2 N1 N2 - 2 sum_c min(n1c N2, n2c N1)) / (N1 N2)`` in exact integers and
  one division; ``1.0`` otherwise (a value never seen, or NULL);
* numeric: ``least(1.0, abs(a - b) / (4.0 * sigma))``; with a null or zero
  sigma ``0`` if equal else ``1``; a missing number is at ``1.0`` from everything;
* terms summed left to right in the spec order, then ``sqrt``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd

# largest term table (distinct left values x right rows) kept for a whole block
COLUMN_CELLS = 8_000_000
CHUNK_CELLS = 1_000_000      # distances computed at once
CELL = 64                    # right rows that are bounded together, at most
TILE = 16                    # left rows that look at cells together
PIVOTS = 12                  # of a block, used with more than RANGED numbers
RANGED = 3
QUANTILES = 511              # places of a number on the curve
MARGIN = 1e-9                # far above the rounding of distances, far below any that matters
LEAST = 8192                 # right rows of a block from which cells are made
TRIAL = 8                    # tiles after which bounds that exclude too little are given up
# screening, with more than RANGED numbers and nothing else (see Screen)
SCREENED = 1024              # right rows of a block from which pairs are screened
SCREEN_CELLS = 8_000_000     # pairs screened at once
SCREEN_GAIN = 16             # pairs screened in the time of one distance, about
SCREEN_TRIAL = 2             # tiles after which bounds that exclude less than that are given up
PLACES = (0, .04, .17, .33, .5, .67, .83, .96, 1)    # quantiles of a number that are its knots
FOLD = 16                    # right rows that share a least bound
CLIP = 16.0                  # spreads (of 4 sigma) from the median beyond which a number counts as this far
WIDE_LEFT, LEFT = 8192, 4096                         # left rows of a block


def vdm_terms(left: list[dict | None], right: list[dict | None]) -> np.ndarray:
    """Squared VDM between the class counts of two lists of values; 1.0 where one is unseen."""
    labels: dict = {}
    for counts in (*left, *right):
        for c in counts or ():
            labels.setdefault(c, len(labels))
    largest = [max((sum(v.values()) for v in side if v), default=0) for side in (left, right)]
    kind = np.int64 if 2 * largest[0] * largest[1] < 2**62 else object     # Python integers beyond

    def matrix(side):
        out = np.zeros((len(labels), len(side)), dtype=kind)
        for i, counts in enumerate(side):
            for c, n in (counts or {}).items():
                out[labels[c], i] = n
        return out, np.array([sum(v.values()) if v else 1 for v in side], dtype=kind)

    a, n1 = matrix(left)
    b, n2 = matrix(right)
    shared = np.zeros((len(left), len(right)), dtype=kind)
    for c in range(len(labels)):
        i, j = np.flatnonzero(a[c]), np.flatnonzero(b[c])
        if len(i) and len(j):
            shared[np.ix_(i, j)] += np.minimum(np.outer(a[c, i], n2[j]), np.outer(n1[i], b[c, j]))
    product = np.outer(n1, n2)
    vdm = (2 * product - 2 * shared).astype(np.float64) / product.astype(np.float64)
    terms = vdm * vdm
    terms[np.array([v is None for v in left], dtype=bool), :] = 1.0
    terms[:, np.array([v is None for v in right], dtype=bool)] = 1.0
    return terms


@dataclass
class Values:
    """The values of one categorical feature in a block: codes into distinct values with
    their class counts; code ``len(distinct)`` is NULL."""

    codes: np.ndarray
    distinct: np.ndarray
    counts: list

    @classmethod
    def of(cls, side: pd.DataFrame, feature: str) -> Values:
        codes, distinct = pd.factorize(side[feature].to_numpy(dtype=object))
        first = np.zeros(len(distinct), dtype=np.int64)
        rows = np.arange(len(codes))[::-1]
        known = codes[::-1] >= 0
        first[codes[::-1][known]] = rows[known]
        packed = side["_v_" + feature].to_numpy(dtype=object)[first]
        counts = [json.loads(x) if isinstance(x, str) else None for x in packed]
        return cls(np.where(codes < 0, len(distinct), codes), np.asarray(distinct, object), counts)

    def rows(self, start: int, stop: int) -> Values:
        """The same for a slice of the block, with only its own values."""
        own, codes = np.unique(self.codes[start:stop], return_inverse=True)
        real = own[own < len(self.distinct)]
        return Values(codes, self.distinct[real], [self.counts[i] for i in real])


def term_table(left: Values, right: Values) -> np.ndarray:
    """Terms between distinct values; the last row and column stand for NULL."""
    out = np.ones((len(left.distinct) + 1, len(right.distinct) + 1))
    if len(left.distinct) and len(right.distinct):
        out[:-1, :-1] = vdm_terms(left.counts, right.counts)
        at = pd.Index(right.distinct).get_indexer(left.distinct)
        same = np.flatnonzero(at >= 0)
        out[same, at[same]] = 0.0
    return out


@dataclass
class Kernel:
    """Distance between rows of two blocks over an ordered feature list."""

    order: tuple            # feature names in summation order
    kinds: dict             # feature -> "cat" | "num"

    def columns(self) -> list[str]:
        """The metric columns that both sides carry."""
        return [("_v_" if self.kinds[f] == "cat" else "_s_") + f for f in self.order]

    @property
    def wide(self) -> bool:
        """Many numbers and nothing else."""
        return len(self.order) > RANGED and all(kind == "num" for kind in self.kinds.values())

    @property
    def left_rows(self) -> int:
        """Left rows of a block: with many numbers more, as right rows are copied to each block of left ones."""
        return WIDE_LEFT if self.wide else LEFT

    def block(self, left: pd.DataFrame, right: pd.DataFrame) -> Block:
        return Block(self, left, right)


def spread(f: str, left: pd.DataFrame, right: pd.DataFrame) -> float:
    """The spread of a number, from whichever side carries it."""
    side = right if "_s_" + f in right else left
    return float(side["_s_" + f].iloc[0]) if len(side) else np.nan


class Block:
    """Two blocks, encoded once; ``distances`` gives slices of left rows."""

    def __init__(self, kernel: Kernel, left: pd.DataFrame, right: pd.DataFrame):
        self.kernel, self.n_left, self.n_right = kernel, len(left), len(right)
        self.left, self.right, self.table, self.sigma = {}, {}, {}, {}
        for f in kernel.order:
            if kernel.kinds[f] == "cat":
                a, b = self.left[f], self.right[f] = Values.of(left, f), Values.of(right, f)
                if (len(a.distinct) + 1) * max(len(right), len(b.distinct)) <= COLUMN_CELLS:
                    self.table[f] = term_table(a, b)[:, b.codes]
            else:
                self.left[f] = left[f].to_numpy(dtype=np.float64)
                self.right[f] = right[f].to_numpy(dtype=np.float64)
                self.sigma[f] = spread(f, left, right)

    def _term(self, f: str, start: int, stop: int) -> np.ndarray:
        if self.kernel.kinds[f] == "cat":
            if f in self.table:
                return self.table[f][self.left[f].codes[start:stop]]
            own = self.left[f].rows(start, stop)
            return term_table(own, self.right[f])[own.codes][:, self.right[f].codes]
        return self.number_terms(f, self.left[f][start:stop], self.right[f])

    def number_terms(self, f: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, s = a[:, None], b[None, :], self.sigma[f]
        if not np.isfinite(s) or s == 0.0:
            return np.where(a == b, 0.0, 1.0)
        t = np.subtract(a, b)              # least(1, abs(a - b) / (4 * s)), in place
        np.abs(t, out=t)
        np.divide(t, 4.0 * s, out=t)
        return np.fmin(t, 1.0, out=t)      # a missing number is at 1.0

    def some_distances(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Distances of some left rows to some right rows."""
        acc = np.zeros((len(rows), len(cols)))
        for f in self.kernel.order:
            if f in self.table:
                acc += self.table[f][self.left[f].codes[rows][:, None], cols[None, :]]
            else:
                acc += self.number_terms(f, self.left[f][rows], self.right[f][cols])
        return np.sqrt(acc, out=acc)

    def pair_distances(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Distances of left rows to one right row each, if all features are numbers."""
        acc = np.zeros(len(rows))
        for f in self.kernel.order:
            a, b, s = self.left[f][rows], self.right[f][cols], self.sigma[f]
            if not np.isfinite(s) or s == 0.0:
                acc += np.where(a == b, 0.0, 1.0)
                continue
            t = np.subtract(a, b, out=a)
            np.abs(t, out=t)
            np.divide(t, 4.0 * s, out=t)
            acc += np.fmin(t, 1.0, out=t)
        return np.sqrt(acc, out=acc)

    def nearest(self, k: int, hide=lambda d, rows, cols: d, within: np.ndarray | None = None,
                compared=None):
        """``(rows, cols, values, rank)`` of the k nearest right rows of the left rows, in parts.

        ``hide(distances, rows, cols)`` puts infinity where a pair is excluded; ``within`` has
        the largest distance of each left row that matters; ``compared`` is told the distances computed."""
        kernel, n = self.kernel, self.n_left
        tables = all(f in self.table for f in kernel.order if kernel.kinds[f] == "cat")
        cells = Cells(self) if tables and self.n_right >= LEAST and k < CELL else None
        order = np.arange(n)
        if cells is not None:
            order = cells.by_values(self.left) if cells.pivots is None else cells.by_pivots(order, self.left, self.table)
        whole, tile, at, looked = np.arange(self.n_right), max(1, CHUNK_CELLS // max(1, self.n_right)), 0, 0
        screens = kernel.wide and self.n_right >= max(SCREENED, 4 * FOLD * k)
        tried, screen, whole_to = 0, None, 0
        while at < n:
            share = (looked + cells.tried) / (at * self.n_right) if cells is not None and at else 0
            if share * 3 > 1 and at >= (SCREEN_TRIAL if screens else TRIAL) * TILE:
                tried, cells, order = cells.tried, None, np.concatenate([order[:at], np.sort(order[at:])])
            if screens and at >= whole_to and (
                    screen or cells is None or at >= SCREEN_TRIAL * TILE and share * SCREEN_GAIN > 1):
                screen = screen or Screen(self)
                rows = order[at:at + max(1, SCREEN_CELLS // self.n_right)]
                found = screen.nearest(rows, k, hide, within)
                if found is None:              # too many are left: back to cells, or all distances of these rows
                    screens, whole_to = cells is None, at + len(rows)
                    continue
                yield found
                at += len(rows)
                continue
            rows = order[at:at + (tile if cells is None else TILE)]
            cols = whole if cells is None else cells.looked_at(rows, k, hide, within)
            if cells is None and rows[-1] - rows[0] + 1 == len(rows):
                d = self.distances(int(rows[0]), int(rows[-1]) + 1)
            elif tables:
                d = self.some_distances(rows, cols)
            else:
                d = np.concatenate([self.distances(int(r), int(r) + 1) for r in rows])
            looked += len(rows) * len(cols)
            i, j, values, rank = topk_per_row(hide(d, rows, cols), k)
            i, j = rows[i], cols[j]
            if within is not None:
                near = values <= within[i]
                i, j, values, rank = i[near], j[near], values[near], rank[near]
            yield i, j, values, rank
            at += len(rows)
        if compared is not None:
            compared.add(looked + (tried if cells is None else cells.tried) + (screen.looked if screen else 0))

    def distances(self, start: int, stop: int) -> np.ndarray:
        acc = np.zeros((stop - start, self.n_right))
        for i, f in enumerate(self.kernel.order):
            t = self._term(f, start, stop)
            acc = t if i == 0 else np.add(acc, t, out=acc)
        return np.sqrt(acc, out=acc)


class Cells:
    """The right rows of a block in cells with lower bounds, for an exact top-k that looks at few rows.

    Rows lie in the order of their values, or with many numbers by their nearest pivot and
    their distance to it; ``CELL`` rows in a row are a cell.  A row's distance to a cell is at least

    * the root of the sum of its least terms: the least term of the values in the cell, or the term to
      the nearer end of the numbers' range (the same operations in the same order as the distance's,
      all monotone under rounding);
    * by the triangle inequality, its distance to a pivot less the largest one of the cell, or the cell's least
      one less its own, with ``MARGIN`` for rounding.  Distances are a metric: the
      VDM is one on class distributions, a seen value is at 1 from an unseen one and at most 2 from
      a seen one, roots of capped differences are one, and the root of a sum of squared metrics is one.
      This holds for changes of rules as for values of cases.
    """

    def __init__(self, block: Block):
        self.block, kernel, self.tried = block, block.kernel, 0
        nums = [f for f in kernel.order if kernel.kinds[f] == "num"]
        self.pivots = self._pivots() if len(nums) > RANGED else None
        if self.pivots is not None:
            rows = np.arange(block.n_right)
            to = self.pivot_distances(rows, block.right, block.table_right)
            self.order = self.by_pivots(rows, block.right, block.table_right)
        else:
            self.order = self.by_values(block.right)
        self.starts = self._borders()
        self.sizes = np.diff(np.append(self.starts, block.n_right))
        if self.pivots is not None:
            self.low = np.minimum.reduceat(to[self.order], self.starts, axis=0)
            self.high = np.maximum.reduceat(to[self.order], self.starts, axis=0)
        self.least, self.range = {}, {}
        for f in kernel.order:
            if f in nums:
                x = block.right[f][self.order]
                self.range[f] = np.fmin.reduceat(x, self.starts), np.fmax.reduceat(x, self.starts)
            else:
                self.least[f] = np.minimum.reduceat(block.table[f][:, self.order], self.starts, axis=1)

    def _borders(self) -> np.ndarray:
        """Where cells begin: after CELL rows, and at other categorical values if these have rows enough."""
        block, n = self.block, self.block.n_right
        new = np.zeros(n, bool)
        new[0] = True
        if self.pivots is None:
            for f in block.table:
                codes = block.right[f].codes[self.order]
                new[1:] |= codes[1:] != codes[:-1]
            if np.count_nonzero(new) * 16 > n:
                new[1:] = False
        run = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        return np.flatnonzero(place % CELL == 0)

    def by_values(self, side: dict) -> np.ndarray:
        """Rows by their categorical values, then along a curve that keeps rows with like numbers together:
        the bits of the numbers' places among the right rows' quantiles, in turns."""
        block, turn = self.block, 0
        nums = [f for f in block.kernel.order if block.kernel.kinds[f] == "num"]
        for i, f in enumerate(nums):
            edges = np.unique(block.right[f][np.isfinite(block.right[f])])
            edges = edges[np.linspace(0, len(edges) - 1, QUANTILES).astype(int)] if len(edges) else edges
            place = np.searchsorted(edges, side[f]).astype(np.int64)      # NaN: behind all
            if len(nums) == 1:
                turn = side[f]
                break
            for bit in range(QUANTILES.bit_length()):
                turn = turn + ((place >> bit & 1) << (bit * len(nums) + i))
        keys = [side[f].codes for f in block.kernel.order if block.kernel.kinds[f] == "cat"]
        return np.lexsort([turn + np.zeros(len(next(iter(side.values())).codes) if keys else len(side[nums[0]])),
                           *reversed(keys)])

    def _pivots(self) -> np.ndarray | None:
        """Right rows far from each other, one after the other (from the first row on)."""
        block = self.block
        if any(len(block.right[f].distinct) ** 2 > COLUMN_CELLS for f in block.table):
            return None
        block.table_right = {f: term_table(v, v) for f, v in block.right.items() if f in block.table}
        found, away = [0], None
        for _ in range(min(PIVOTS, block.n_right) - 1):
            self.pivots = np.array(found[-1:])
            d = self.pivot_distances(np.arange(block.n_right), block.right, block.table_right)[:, 0]
            away = d if away is None else np.minimum(away, d)
            found.append(int(away.argmax()))
        return np.array(found)

    def by_pivots(self, rows: np.ndarray, side: dict, tables: dict) -> np.ndarray:
        """Rows by their nearest pivot and their distance to it."""
        to = self.pivot_distances(rows, side, tables)
        near = to.argmin(axis=1)
        return np.lexsort((to[rows, near], near))

    def pivot_distances(self, rows: np.ndarray, side: dict, tables: dict) -> np.ndarray:
        block, acc = self.block, np.zeros((len(rows), len(self.pivots)))
        for f in block.kernel.order:
            if f in tables:
                at = block.right[f].codes[self.pivots]
                acc += tables[f][side[f].codes[rows]][:, at if tables is block.table_right else self.pivots]
            else:
                acc += block.number_terms(f, side[f][rows], block.right[f][self.pivots])
        return np.sqrt(acc)

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of left rows to the cells."""
        block, acc = self.block, np.zeros((len(rows), len(self.starts)))
        for f in block.kernel.order:
            if f in self.least:
                acc += self.least[f][block.left[f].codes[rows]]
                continue
            x, (lo, hi), s = block.left[f][rows, None], self.range[f], block.sigma[f]
            if not np.isfinite(s) or s == 0.0:
                t = np.where((x >= lo) & (x <= hi), 0.0, 1.0)
            else:
                below, above = np.abs(x - lo) / (4.0 * s), np.abs(x - hi) / (4.0 * s)
                t = np.fmin(np.where(x < lo, below, np.where(x > hi, above, 0.0)), 1.0)
                t[np.isnan(x) | np.isnan(lo)] = 1.0
            acc += t
        acc = np.sqrt(acc, out=acc)
        if self.pivots is not None:
            own = self.pivot_distances(rows, block.left, block.table)
            for p in range(len(self.pivots)):
                x = own[:, p, None]
                np.maximum(acc, np.maximum(self.low[:, p] - x, x - self.high[:, p]) - MARGIN, out=acc)
        return acc

    def columns(self, cells: np.ndarray) -> np.ndarray:
        """The right rows of some cells, in the rows' own order."""
        at = [self.order[self.starts[c]:self.starts[c] + self.sizes[c]] for c in cells]
        return np.sort(np.concatenate(at))

    def looked_at(self, rows: np.ndarray, k: int, hide, within) -> np.ndarray:
        """The right rows among which the k nearest of all ``rows`` are."""
        bound = self.bounds(rows)
        limit = np.full(len(rows), np.inf) if within is None else within[rows]
        seen, best = np.zeros(len(self.starts), bool), np.full((len(rows), k), np.inf)
        for near in (2, 6):                # cells a row: the nearest ones first, for a limit of the others
            left = np.where(seen | (bound > limit[:, None]), np.inf, bound)
            near = min(near, left.shape[1])
            cells = np.argpartition(left, near - 1, axis=1)[:, :near]
            new = np.unique(cells[np.isfinite(np.take_along_axis(left, cells, axis=1))])
            if not len(new):
                break
            seen[new] = True
            cols = self.columns(new)
            self.tried += len(rows) * len(cols)
            best = np.concatenate([best, hide(self.block.some_distances(rows, cols), rows, cols)], axis=1)
            best = np.partition(best, k - 1, axis=1)[:, :k]
            limit = np.minimum(limit, best.max(axis=1))
        return self.columns(np.flatnonzero(seen | (bound <= limit[:, None]).any(axis=0)))


class Screen:
    """Lower bounds of all pairs of a block by one matrix product in single precision, for an exact top-k that
    computes the distances of the few pairs below the k-th one.

    A number's term as a function of the right value is ``min(1, |a - b|)`` in spreads of 4 sigma.  Through its values at
    knots (quantiles of the right values, their ends included) runs a polygon that is nowhere above it, except next
    to ``a``: there the nearer knot gets its distance to ``a`` with a minus, so both edges at that knot stay below.  The value of
    the polygon at ``b`` weighs the two knots around ``b``, so the sum over the numbers is the product of a row of polygons and
    a row of weights.  Terms of numbers without spread count as 0 at least; a missing right number counts as
    its first knot, whose term is 1 at most.  ``margin`` is above the rounding of the product.
    """

    def __init__(self, block: Block):
        self.block, self.knots, self.centre, self.looked = block, {}, {}, 0
        self.groups, width = -(-block.n_right // FOLD), 0
        self.weights = np.zeros((self.groups * FOLD, len(block.sigma) * (len(PLACES) - 1)), np.float32)
        for f, s in block.sigma.items():
            if not np.isfinite(s) or s == 0.0:
                continue
            x = block.right[f]
            some = x[np.isfinite(x)]
            self.centre[f] = np.median(some) if len(some) else 0.0
            v = self._scaled(f, x)
            there = np.flatnonzero(~np.isnan(v))
            if not len(there):
                del self.centre[f]
                continue
            knots = self.knots[f] = np.unique(np.quantile(v[there], PLACES))
            if len(knots) > 1:
                v = v[there]
                i = np.clip(np.searchsorted(knots, v, side="right") - 1, 0, len(knots) - 2)
                part = np.clip((v - knots[i]) / (knots[i + 1] - knots[i]), 0.0, 1.0)
                self.weights[there, width + i] = part          # the first knot's weight is what is missing to 1
                inner = i > 0
                self.weights[there[inner], width + i[inner] - 1] = 1.0 - part[inner]
            width += len(knots) - 1
        self.weights = self.weights[:, :width]
        self.margin = (width + len(self.knots) + 8) * 2.0**-23 * 2 * max(1, len(self.knots))

    def _scaled(self, f: str, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.clip((x - self.centre[f]) / (4.0 * self.block.sigma[f]), -CLIP, CLIP)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(parts, base)``: a lower bound of the sum of terms of each pair is its part and its row's base."""
        base, polygons = np.zeros(len(rows)), []
        for f, knots in self.knots.items():
            a = self._scaled(f, self.block.left[f][rows])
            g = np.fmin(np.abs(a[:, None] - knots), 1.0)      # a missing left number is at 1
            i = np.searchsorted(knots, a, side="right") - 1
            inside = np.flatnonzero((i >= 0) & (i < len(knots) - 1))
            i, x = i[inside], a[inside]
            below, above = x - knots[i], knots[i + 1] - x
            g[inside, np.where(below <= above, i, i + 1)] = -np.minimum(np.minimum(below, above), 1.0)
            base += g[:, 0]
            polygons.append((g[:, 1:] - g[:, :1]).astype(np.float32))
        if not polygons:
            return np.zeros((len(rows), len(self.weights)), np.float32), base
        low = np.concatenate(polygons, axis=1) @ self.weights.T
        low[:, self.block.n_right:] = np.inf
        return low, base

    def nearest(self, rows: np.ndarray, k: int, hide, within: np.ndarray | None):
        """``(rows, cols, values, rank)`` of the k nearest right rows of each of ``rows``; None if the bounds exclude
        too little."""
        block, n = self.block, len(rows)
        low, base = self.bounds(rows)
        shown = low[:, :block.n_right]
        hidden = hide(shown, rows, np.arange(block.n_right))
        if hidden is not shown:
            shown[:] = hidden
        folded = low.reshape(n, FOLD, self.groups)
        least = folded.min(axis=1)
        # the least bounds of k groups belong to k right rows: the largest of their distances is a limit
        g = np.argpartition(least, k - 1, axis=1)[:, :k]
        first = np.arange(n)[:, None]
        col = (folded[first, :, g].argmin(axis=2) * self.groups + g).ravel()
        row = np.repeat(np.arange(n), k)
        shown = np.isfinite(low[row, col])
        d = np.full(n * k, np.inf)
        d[shown] = block.pair_distances(rows[row[shown]], col[shown])
        self.looked += len(d)
        limit = d.reshape(n, k).max(axis=1)
        if within is not None:
            limit = np.minimum(limit, within[rows])
        most = np.where(np.isfinite(limit), limit * limit * (1 + 1e-9) - base + self.margin, 1e9)    # above all bounds
        most = np.nextafter(most.astype(np.float32), np.float32(np.inf))[:, None]
        near = least <= most
        if np.count_nonzero(near) * 4 > near.size:
            i, j = np.nonzero(low <= most)
        else:
            i, g = np.nonzero(near)
            near, at = np.nonzero(folded[i, :, g] <= most[i])
            i, j = i[near], at * self.groups + g[near]
        if len(i) * 8 > n * block.n_right:
            return None
        self.looked += len(i)
        values = block.pair_distances(rows[i], j)
        if within is not None:
            some = values <= within[rows[i]]
            i, j, values = i[some], j[some], values[some]
        order = np.lexsort((j, values, i))
        i, j, values = i[order], j[order], values[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        keep = rank < k
        return rows[i[keep]], j[keep], values[keep], rank[keep] + 1


def topk_per_row(d: np.ndarray, k: int):
    """Per row of ``d``, the ``k`` smallest entries ordered by (value, column).

    Columns are expected in key order, so the column index is the tie-break.
    ``argpartition`` yields k candidates per row; only rows where more than k
    entries reach the k-th value (ties at the boundary) are rescanned in full.
    Infinite entries are excluded pairs (every distance is finite) and dropped.
    Returns ``(rows, cols, values, rank)`` with rank starting at 1.
    """
    c, n = d.shape
    if c == 0 or n == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0), e
    if n <= k:
        rows = np.repeat(np.arange(c), n)
        cols = np.tile(np.arange(n), c)
    else:
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        kth = np.take_along_axis(d, part, axis=1).max(axis=1)
        tie = np.count_nonzero(d <= kth[:, None], axis=1) > k
        keep_rows = ~tie
        rows = np.repeat(np.nonzero(keep_rows)[0], k)
        cols = part[keep_rows].ravel()
        if tie.any():
            # rows with more than k entries at the k-th value: everything below
            # it, then the first (smallest-key) columns at it, k per row at most
            tr = np.nonzero(tie)[0]
            sub, kv = d[tr], kth[tr][:, None]
            lt = sub < kv
            eqm = sub == kv
            need = k - np.count_nonzero(lt, axis=1)
            take = eqm & (np.cumsum(eqm, axis=1, dtype=np.int32) <= need[:, None])
            r2, c2 = np.nonzero(lt | take)
            rows = np.concatenate([rows, tr[r2]])
            cols = np.concatenate([cols, c2])
    vals = d[rows, cols]
    fin = np.isfinite(vals)
    rows, cols, vals = rows[fin], cols[fin], vals[fin]
    order = np.lexsort((cols, vals, rows))
    rows, cols, vals = rows[order], cols[order], vals[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = rank < k
    return rows[keep], cols[keep], vals[keep], rank[keep] + 1


def topk_weighted(d: np.ndarray, w: np.ndarray, k: int):
    """Per row, the columns up to the smallest distance whose cumulative weight
    reaches ``k``; of those at that distance, the first ``k``.

    Used on compressed blocks where a column is a profile standing for ``w >= 1``
    cases, in the order of each profile's smallest key: of profiles at one distance, only
    the first ``k`` can hold one of the ``k`` smallest keys.  The ``k`` nearest
    columns weigh at least ``k``, so the distance is found among them.  At most
    ``2 k`` columns a row.  Returns ``(rows, cols, values)``.
    """
    c, n = d.shape
    if c == 0 or n == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0)
    m = min(k, n)
    part = np.argpartition(d, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(d, part, axis=1)
    order = np.argsort(near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, axis=1)
    reach = np.cumsum(w[np.take_along_axis(part, order, axis=1)], axis=1) >= k
    pos = np.where(reach.any(axis=1), reach.argmax(axis=1), m - 1)
    thr = near[np.arange(c), pos][:, None]
    at = d == thr
    rows, cols = np.nonzero((d < thr) | (at & (np.cumsum(at, axis=1, dtype=np.int32) <= k)))
    vals = d[rows, cols]
    fin = np.isfinite(vals)
    return rows[fin], cols[fin], vals[fin]
