"""Sums of plain Euclidean distances from every row to classes of rows, without a distance for every pair.

Rows near each other are compared one by one. From a box of rows that is far away for its size, distances are a smooth function:
they are interpolated by polynomials, with as many terms in each feature as ``PRECISION`` takes, so a box counts as a few
hundred weighted nodes. Every pair is in the sums; what differs from adding all distances is below the rounding of long sums.
Boxes that would need more nodes than they have rows (many features of like width) are compared row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

APART = 1.5  # boxes are distant whose gap is so many times the larger half side
PRECISION = 1e-11  # of a distance between distant boxes
MOST_NODES = 1024
MOST_TERMS = 400_000  # looked through for the terms of a box
LEAF = 4096  # rows of a box that is not cut any further: about where its nodes stop being far fewer
CELLS = 1 << 16  # distances held at a time, so that they stay in a core's cache


@dataclass(frozen=True)
class Expansion:
    """Polynomials in [-1, 1] of each feature: their degrees, the nodes that tell them, and what makes coefficients of values there."""

    degrees: np.ndarray
    nodes: np.ndarray

    @cached_property
    def solve(self) -> np.ndarray:
        return np.linalg.inv(self.basis(self.nodes).T)

    def basis(self, x: np.ndarray) -> np.ndarray:
        """(terms, rows): Chebyshev products at points in [-1, 1]."""
        out = np.ones((len(self.degrees), len(x)))
        for f in range(x.shape[1]):
            most = int(self.degrees[:, f].max())
            if most:
                t = [np.ones(len(x)), x[:, f]]
                for _ in range(most - 1):
                    t.append(2 * x[:, f] * t[-1] - t[-2])
                out *= np.stack(t)[self.degrees[:, f]]
        return out


def _leja(n: int) -> np.ndarray:
    """Points of [-1, 1] of which every beginning interpolates well: each is where the product of distances to those before is greatest."""
    grid = np.cos(np.pi * np.arange(4001) / 4000)
    points, product = [1.0], np.zeros(len(grid))
    for _ in range(n - 1):
        product = product + np.log(np.maximum(np.abs(grid - points[-1]), 1e-300))
        points.append(float(grid[np.argmax(product)]))
    return np.array(points)


@lru_cache(maxsize=256)
def _expansion(shape: tuple[float, ...]) -> Expansion | None:
    """For boxes with sides in this proportion, the greatest being 1; None if it takes too many nodes.

    Seen from a gap of ``APART`` greatest half sides, the distance can be continued to complex features up to the gap, which features share. Chebyshev
    coefficients of a term fall with its degree in each feature by the growth of the ellipse that lies within.
    """

    def growth(reach: np.ndarray) -> np.ndarray:
        return np.log(reach + np.sqrt(1 + reach * reach))

    budget = -math.log(PRECISION)
    reach = [APART / s if s else math.inf for s in shape]
    most = [int(budget / growth(r)) if math.isfinite(r) else 0 for r in reach]
    if math.prod(m + 1 for m in most) > MOST_TERMS:
        return None
    degrees = np.stack(np.meshgrid(*[np.arange(m + 1.0) for m in most], indexing="ij"), -1)
    total = np.maximum(degrees.sum(-1), 1.0)
    fall = np.zeros(total.shape)
    for f, m in enumerate(most):
        if m:
            fall += degrees[..., f] * growth(reach[f] * np.sqrt(degrees[..., f] / total))
    kept = fall <= budget
    for f in range(len(most)):  # with a term all of lower degrees, so that the nodes below tell them apart
        kept = np.flip(np.logical_or.accumulate(np.flip(kept, f), axis=f), f)
    if kept.sum() > MOST_NODES:
        return None
    chosen = np.argwhere(kept)
    return Expansion(chosen, _leja(int(chosen.max()) + 1)[chosen])


class Box:
    """The box around ``n`` rows, and the nodes that stand for them if these are fewer than half as many."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, n: int) -> None:
        self.lo, self.hi, self.n = lo, hi, n
        self.half = (hi - lo) / 2
        self.centre = lo + self.half
        self.reach = float(self.half.max(initial=0.0))
        self.shape: tuple[float, ...] | None = None  # its expansion is found by that where it is needed, and not sent with the box
        if math.isfinite(self.reach) and np.isfinite(self.centre).all():
            sides = self.half / self.reach if self.reach else np.zeros(len(self.half))
            # sides are rounded up to half powers of two, so that boxes of about one shape share their nodes
            up = [2.0 ** (math.ceil(2 * math.log2(s)) / 2) if s > 0 else 0.0 for s in sides.tolist()]
            self.shape = tuple(min(u, 1.0) for u in up)
        if self.expansion is None or 2 * len(self.expansion.nodes) > n:
            self.shape = None

    @property
    def expansion(self) -> Expansion | None:
        return None if self.shape is None else _expansion(self.shape)

    def nodes(self) -> np.ndarray:
        return self.centre + self.expansion.nodes * self.half

    def _basis(self, x: np.ndarray) -> np.ndarray:
        return self.expansion.basis((x - self.centre) / np.where(self.half > 0, self.half, 1.0))

    def moments(self, x: np.ndarray, member: np.ndarray) -> np.ndarray:
        """(terms, classes): sums over rows, which may be added up over parts of the box."""
        total = np.zeros((len(self.expansion.nodes), member.shape[1]))
        for at in range(0, len(x), 1024):
            total += self._basis(x[at : at + 1024]) @ member[at : at + 1024]
        return total

    def weights(self, moments: np.ndarray) -> np.ndarray:
        """(nodes, classes): what its nodes weigh in place of the rows."""
        return self.expansion.solve.T @ moments

    def spread(self, values: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
        """Adds to ``out`` at rows what stands at the nodes."""
        coefficients = self.expansion.solve @ values
        for at in range(0, len(x), 1024):
            out[at : at + 1024] += self._basis(x[at : at + 1024]).T @ coefficients


def gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Least distances between a box and others."""
    return np.sqrt((np.maximum(np.maximum(los - hi, lo - his), 0.0) ** 2).sum(axis=-1))


def distant(a: Box, b: Box) -> bool:
    return bool(gaps(a.lo, a.hi, b.lo, b.hi) >= APART * max(a.reach, b.reach))


def _near_sums(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, out_x: np.ndarray, out_y: np.ndarray | None) -> None:
    """Adds the sums of distances between rows, feature by feature in place: no array of all differences."""
    across, width = np.ascontiguousarray(y.T), max(1, min(1024, len(y)))
    step = max(1, CELLS // width)
    for start in range(0, len(x), step):
        rows = x[start : start + step]
        for at in range(0, len(y), width):
            there = across[:, at : at + width]
            far = np.zeros((len(rows), there.shape[1]))
            away = np.empty_like(far)
            for f in range(x.shape[1]):
                np.subtract(rows[:, f, None], there[f], out=away)
                np.multiply(away, away, out=away)
                np.add(far, away, out=far)
            np.sqrt(far, out=far)
            out_x[start : start + step] += far @ of_y[at : at + width]
            if out_y is not None:
                out_y[at : at + width] += far.T @ of_x[start : start + step]


def far_sums(x: np.ndarray, y: np.ndarray, of_x: np.ndarray | None, of_y: np.ndarray, out_x: np.ndarray, out_y: np.ndarray | None, centre: np.ndarray) -> None:
    """The same of points in distant boxes, ``centre`` being that of ``x``: squares of distances are no small differences of large numbers there."""
    x, y = x - centre, y - centre
    left = np.concatenate([-2 * x, (x * x).sum(axis=1)[:, None], np.ones((len(x), 1))], axis=1)
    right = np.concatenate([y, np.ones((len(y), 1)), (y * y).sum(axis=1)[:, None]], axis=1).T
    for at in range(0, len(y), 2048):
        there = np.ascontiguousarray(right[:, at : at + 2048])
        for start in range(0, len(x), 32):
            far = left[start : start + 32] @ there
            np.maximum(far, 0.0, out=far)
            np.sqrt(far, out=far)
            out_x[start : start + 32] += far @ of_y[at : at + 2048]
            if out_y is not None:
                out_y[at : at + 2048] += far.T @ of_x[start : start + 32]


class Rows:
    """Rows of a block with the class each is in, cut at the middle of the widest side again and again, and the sums found for them."""

    def __init__(self, x: np.ndarray, member: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.root = self._grown(x, 0, len(x))
        self.x, self.member = x[self.order], member[self.order]
        self.out = np.zeros(member.shape)

    def _grown(self, x: np.ndarray, start: int, stop: int) -> _Part:
        rows = self.order[start:stop]
        box = Box(x[rows].min(axis=0), x[rows].max(axis=0), stop - start)
        part = _Part(self, start, stop, box)
        if len(rows) > LEAF and box.reach > 0:
            widest = x[rows, int(np.argmax(box.half))]
            middle = len(rows) // 2
            self.order[start:stop] = rows[np.argpartition(widest, middle)]
            part.halves = self._grown(x, start, start + middle), self._grown(x, start + middle, stop)
        return part

    def sums(self) -> np.ndarray:
        """By row as given and class."""
        self.root.settle()
        found = np.empty(self.out.shape)
        found[self.order] = self.out
        return found


class _Part:
    def __init__(self, rows: Rows, start: int, stop: int, box: Box) -> None:
        self.rows, self.at, self.box, self.halves = rows, slice(start, stop), box, ()
        self.weights, self.values = None, None

    def points(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes or rows, what they weigh in each class, and where sums at them are added."""
        if self.box.expansion is None:
            return self.rows.x[self.at], self.rows.member[self.at], self.rows.out[self.at]
        if self.weights is None:
            self.weights = self.box.weights(self.box.moments(self.rows.x[self.at], self.rows.member[self.at]))
            self.values = np.zeros(self.weights.shape)
        return self.box.nodes(), self.weights, self.values

    def settle(self) -> None:
        if self.values is not None:
            self.box.spread(self.values, self.rows.x[self.at], self.rows.out[self.at])
            self.values = None
        for half in self.halves:
            half.settle()


def _meet(a: _Part, b: _Part) -> None:
    if a is b:
        if a.halves:
            left, right = a.halves
            _meet(left, left), _meet(right, right), _meet(left, right)
        elif not a.box.reach == 0:
            _near_sums(*[a.rows.x[a.at]] * 2, *[a.rows.member[a.at]] * 2, a.rows.out[a.at], None)
    elif distant(a.box, b.box) and (a.box.expansion or b.box.expansion):
        (x, of_x, out_x), (y, of_y, out_y) = a.points(), b.points()
        far_sums(x, y, of_x, of_y, out_x, out_y, a.box.centre)
    elif a.halves and (a.box.reach >= b.box.reach or not b.halves):
        for half in a.halves:
            _meet(half, b)
    elif b.halves:
        for half in b.halves:
            _meet(a, half)
    else:
        _near_sums(a.rows.x[a.at], b.rows.x[b.at], a.rows.member[a.at], b.rows.member[b.at], a.rows.out[a.at], b.rows.out[b.at])


def meet(a: Rows, b: Rows) -> None:
    """Adds to both the sums of distances to the other's rows; with ``a`` itself as ``b``, among its own."""
    _meet(a.root, b.root)


@dataclass(frozen=True)
class Cuts:
    """A tree of cuts through the space of rows: at a place of it, the feature and value that are compared, or a cell."""

    feature: np.ndarray
    value: np.ndarray
    after: np.ndarray  # of a cut: the place for rows up to its value, the one for others follows it
    cell: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        place, every = np.zeros(len(x), int), np.arange(len(x))
        while (open_ := self.cell[place] < 0).any():
            above = ~(x[every, self.feature[place]] <= self.value[place])
            place = np.where(open_, self.after[place] + above, place)
        return self.cell[place]


def cut(x: np.ndarray, cells: int) -> Cuts:
    """Into about so many cells of equally many rows, across the widest side each; ``x`` are rows enough to tell where."""
    x = x[np.isfinite(x).all(axis=1)]
    feature, value, after, cell, todo, n = [0], [0.0], [0], [-1], [(0, x, cells)], 0
    while todo:
        place, rows, wanted = todo.pop()
        sides = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        if wanted < 2 or len(rows) < 2 or not sides.max(initial=0.0) > 0:
            cell[place], n = n, n + 1
            continue
        f = int(np.argmax(sides))
        first = wanted // 2
        ranked = np.sort(rows[:, f])
        at = ranked[max(0, len(ranked) * first // wanted - 1)]
        if at == ranked[-1]:
            at = ranked[np.searchsorted(ranked, at) - 1]
        below = rows[:, f] <= at
        feature[place], value[place], after[place] = f, float(at), len(cell)
        todo += [(len(cell), rows[below], first), (len(cell) + 1, rows[~below], wanted - first)]
        feature, value, after, cell = feature + [0, 0], value + [0.0, 0.0], after + [0, 0], cell + [-1, -1]
    return Cuts(np.array(feature), np.array(value), np.array(after), np.array(cell))
