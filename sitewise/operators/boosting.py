"""Boosted trees of many training sets at once, from histograms of gradients.

A training set is a value of the ``model`` column, as for the logistic models.  Features are cut into bins at quantiles once; a missing value is a bin of
its own and goes to the side that gains more.  Rows with the same bins of the columns that a tree sees go the same way through it, so they are added up
to one cell first and the tree is grown from the cells, whatever the number of rows; only where there are more than ``CELLS`` it is grown from the rows.
A node of a tree of two columns is a box of their grid, so its sums are differences of running sums, and no level goes over the cells.

Sets of up to ``TASK_CELLS`` bins are grown whole, each in a task.  Larger ones are grown together: tasks add up the gradients of their rows per (set, cell),
only those sums are shuffled, and each set's tree is grown in a task.  With too many cells it goes level by level: sums per (set, node, feature, bin),
the split of each node is chosen in a task, and the driver sees one row per node.  Rows are written with their margins every ``BLOCK`` trees; in
between tasks apply the few trees since.  Gradients are whole multiples of 2^-24, so sums do not depend on the order in which they are added: all
ways give the same trees.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F, types as T

from sitewise.operators.joins import group_join
from sitewise.session import durable

#: Bins of a feature, the first for missing values; bins of a set that one task grows alone (a row of four features takes some 100 bytes of its
#: Python); trees between two writes; large sets grown together; partitions that whole sets are dealt to.
BINS, TASK_CELLS, BLOCK, TOGETHER, SETS_APART = 256, 1 << 26, 16, 32, 2000
#: Combinations of bins of a tree's columns that are held at once, their numbers in two bytes; rows handled at a time, few enough for the processor's cache.
CELLS, PIECE = 1 << 16, 1 << 15
#: Choices of columns of which each row's cell is kept; rows beyond which quantiles are those of the rows, however many sets have them.
KNOWN, MANY = 16, 1_000_000
UNIT = float(1 << 24)
_U = np.uint64

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Boosting:
    """Trees per set, their depth, the share of a leaf that counts, shares of rows and columns that a tree sees, and what keeps leaves small."""

    trees: int = 1000
    depth: int = 9
    step: float = 0.01
    rows: float = 0.8
    columns: float = 0.7
    ridge: float = 1.0
    least: float = 1.0
    seed: int = 71017


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x ^ (x >> _U(33))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= _U(factor)
        x ^= x >> _U(33)
    return x


def sampled(row: np.ndarray, tree: int, how: Boosting) -> np.ndarray:
    """Which rows a tree sees, by the hash of their number."""
    salt = mixed(np.array([how.seed * 1_000_003 + tree + 1], _U))
    limit = math.ceil(how.rows * float(1 << 53)) << 11
    drawn = mixed(row.astype(_U, copy=False) ^ salt)
    return drawn < _U(limit) if limit < 1 << 64 else np.ones(len(drawn), bool)


def seen_columns(width: int, tree: int, how: Boosting) -> np.ndarray:
    """Which columns a tree sees, at least one."""
    salt = _U(how.seed * 1_000_003 + tree + 1)
    order = np.argsort(mixed(mixed(np.arange(1, width + 1, dtype=_U)) ^ mixed(np.array([salt]) * _U(0x9E3779B97F4A7C15))), kind="stable")
    return np.sort(order[: max(1, int(how.columns * width))])


class Tree:
    """A tree whose node i has children 2i + 1 and 2i + 2; ``feature`` is -1 in leaves.

    ``leaves_of`` has, of a tree just grown from a whole grid of cells, the leaves' boxes and numbers.
    """

    leaves_of: tuple[Boxes, np.ndarray] | None = None

    def __init__(self, depth: int):
        n = (1 << (depth + 1)) - 1
        self.feature, self.bin, self.missing_left = np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n, bool)
        self.value = np.zeros(n)

    def step(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Where rows at ``node`` stand one level further down."""
        f = self.feature[node]
        own = bins[np.arange(len(node)), np.maximum(f, 0)]
        left = np.where(own == 0, self.missing_left[node], own <= self.bin[node])
        return np.where(f < 0, node, 2 * node + 2 - left)

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            node = self.step(bins, node)
        return node


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, in units of 2^-24."""
    p = np.exp(-margin)
    p += 1.0
    np.divide(1.0, p, out=p)
    g, h = p - y, 1.0 - p
    h *= p
    for x in (g, h):
        x *= UNIT
        np.rint(x, out=x)
    return g, h


def histograms(place: np.ndarray, n: int, bins: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums (node, column, bin, 2) of the derivatives of rows at ``place`` of ``n`` nodes."""
    out = np.empty((n, len(columns), BINS, 2))
    for i, c in enumerate(columns):
        at = place * BINS + bins[:, c]
        for k, values in enumerate((g, h)):
            out[:, i, :, k] = np.bincount(at, values, n * BINS).reshape(n, BINS)
    return out


def best_splits(sums: np.ndarray, how: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node's sums (node, column, bin, 2): does a split gain, and its column, bin and whether missing values go left.

    Of equal gains the first column, bin and side stand.
    """
    sums = sums / UNIT
    total = sums[:, :1].sum(2, keepdims=True)
    missing = sums[:, :, :1]
    below = np.cumsum(sums[:, :, 1:], axis=2)
    # (node, column, bin, side of the missing values, derivative)
    left = np.stack([below + missing, below], axis=3)
    right = total[:, :, :, None] - left
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + how.ridge)
    gain = worth(left) + worth(right) - worth(total)[:, :, :, None]
    gain = np.where((left[..., 1] >= how.least) & (right[..., 1] >= how.least), gain, 0.0).reshape(len(sums), -1)
    at = gain.argmax(1)
    column, rest = np.divmod(at, 2 * (BINS - 1))
    return gain[np.arange(len(at)), at] > 1e-6, column, rest // 2 + 1, rest % 2 == 0


def leaf_values(g: np.ndarray, h: np.ndarray, how: Boosting) -> np.ndarray:
    return -how.step * (g / UNIT) / (h / UNIT + how.ridge)


class Boxes:
    """Nodes of a tree of two columns: of each column the bins from ``low`` to ``high``, and is the bin of missing values there."""

    def __init__(self, low: np.ndarray, high: np.ndarray, missing: np.ndarray):
        self.low, self.high, self.missing = low, high, missing

    @classmethod
    def root(cls, shape: np.ndarray) -> Boxes:
        return cls(np.ones((1, 2), np.int64), shape[None] - 1, np.ones((1, 2), bool))

    def of(self, which: np.ndarray) -> Boxes:
        return Boxes(self.low[which], self.high[which], self.missing[which])

    @classmethod
    def joined(cls, parts: list[Boxes]) -> Boxes:
        return cls(*(np.concatenate([getattr(b, x) for b in parts]) for x in ("low", "high", "missing")))

    def children(self, which: np.ndarray, column: np.ndarray, cut: np.ndarray, missing_left: np.ndarray) -> Boxes:
        """The left and the right child of each of the boxes ``which``, one after the other."""
        low, high, missing = (np.repeat(x[which], 2, axis=0) for x in (self.low, self.high, self.missing))
        left = np.arange(0, len(low), 2)
        high[left, column] = np.maximum(np.minimum(cut, high[left, column]), low[left, column] - 1)
        low[left + 1, column] = np.maximum(cut + 1, low[left + 1, column])
        missing[left, column] &= missing_left
        missing[left + 1, column] &= ~missing_left
        return Boxes(low, high, missing)

    def cells(self, which: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many cells each of the boxes ``which`` has, and their numbers."""
        low, missing = self.low[which], self.missing[which].astype(np.int64)
        size = self.high[which] - low + 1 + missing
        bins = []
        row = np.repeat(np.arange(len(low)), size[:, 0])
        for i, (own, place) in enumerate(((row, runs(size[:, 0])), (np.repeat(row, size[row, 1]), runs(size[row, 1])))):
            bins.append(np.where(place < missing[own, i], 0, low[own, i] + place - missing[own, i]))
        return size.prod(1), np.repeat(bins[0], size[row, 1]) * shape[1] + bins[1]


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def pair_splits(sums: np.ndarray, shape: np.ndarray, boxes: Boxes, total: np.ndarray, how: Boosting):
    """As ``best_splits`` for boxes of a grid; also the sums left of each split.

    ``sums`` are per derivative the grid's running sums along its second column and, turned round, along its first, one behind the other.
    """
    low, high, missing = boxes.low.ravel(), boxes.high.ravel(), boxes.missing.ravel()
    # of each box and column, the other column's ends and where the column's sums begin
    other_low, other_high, other_missing = (x[:, ::-1].ravel() for x in (boxes.low, boxes.high, boxes.missing))
    width = np.tile(shape[::-1] + 1, len(boxes.low))
    begins = np.tile(np.array([0, shape[0] * (shape[1] + 1)]), len(boxes.low))
    # a box is cut at its own bins, and before the first to part the missing values from all others
    begin = np.maximum(low - 1, 1)
    count = np.maximum(high - begin + 1, 0)
    part = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    place = np.arange(len(part)) + (begin - first)[part]

    def strips(start: np.ndarray, above: np.ndarray, below: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Sums (derivative, strip) of one bin of a column of boxes; in those of ``gap`` with the other column's missing values."""
        here = sums.take(start + above, axis=1)
        here -= sums.take(start + below, axis=1)
        if len(gap):
            here[:, gap] += sums.take(start[gap] + 1, axis=1) - sums.take(start[gap], axis=1)
        return here

    base = begins[part] + place * width[part]
    own = strips(base, (other_high + 1)[part], other_low[part], np.flatnonzero(other_missing[part]))
    own[:, first[(place.take(np.minimum(first, len(place) - 1)) < low) & (count > 0)] if len(place) else first[:0]] = 0.0
    ends = np.zeros((2, len(part) + 1))
    np.cumsum(own, axis=1, out=ends[:, 1:])
    below = ends[:, 1:] - ends.take(first, axis=1).take(part, axis=1)
    absent = np.where(missing, strips(begins, other_high + 1, other_low, np.flatnonzero(other_missing)), 0.0)

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g**2 / (h + how.ridge)

    whole = worth(*total)

    def gain(box: np.ndarray, left: np.ndarray) -> np.ndarray:
        right = total.take(box, axis=1)
        right -= left
        found = worth(*left) + worth(*right) - whole[box]
        found[(left[1] < how.least) | (right[1] < how.least)] = 0.0
        return found

    box = part // 2
    left = below + absent.take(part, axis=1)
    best = gain(box, left)
    other = np.flatnonzero(absent.any(0)[part])  # elsewhere both sides are the same
    apart = gain(box[other], below.take(other, axis=1))
    better = apart > best[other]
    other = other[better]
    best[other] = apart[better]
    side = np.ones(len(best), bool)
    side[other] = False
    left[:, other] = below[:, other]

    cuts = count.reshape(-1, 2).sum(1)
    some = np.flatnonzero(cuts)
    most = np.zeros(len(cuts))
    at = np.zeros(len(cuts), np.int64)
    if len(some):
        most[some] = np.maximum.reduceat(best, first[::2][some])
        equal = np.flatnonzero(best == most[box])
        at[some] = equal[np.searchsorted(box[equal], some)]
    gains = most > 1e-6
    at = at[gains]
    cut = np.where(place[at] < low[part[at]], 1, place[at])
    return gains, part[at] % 2, cut, side[at], left[:, at]


def pair_grown(sums: np.ndarray, shape: np.ndarray, columns: np.ndarray, how: Boosting) -> tuple[Tree, tuple[Boxes, np.ndarray]]:
    """The tree of two columns and its leaves from the sums (derivative, cell) of their grid: no node goes over its cells, its bins' sums are differences."""
    tree = Tree(how.depth)
    sums, (n, m) = sums / UNIT, shape.tolist()
    running = np.zeros((2, n * (m + 1) + m * (n + 1)))
    for x, out in zip(sums, running, strict=True):
        np.cumsum(x.reshape(n, m), axis=1, out=out[: n * (m + 1)].reshape(n, m + 1)[:, 1:])
        np.cumsum(x.reshape(n, m).T, axis=1, out=out[n * (m + 1) :].reshape(m, n + 1)[:, 1:])
    node, boxes, total = np.zeros(1, np.int64), Boxes.root(shape), sums.sum(1, keepdims=True)
    ends = []
    for level in range(how.depth + 1):
        tree.value[node] = -how.step * total[0] / (total[1] + how.ridge)
        open_ = np.flatnonzero((total[1] >= 2 * how.least) & (level < how.depth))
        if len(open_) < len(node):
            closed = np.setdiff1d(np.arange(len(node)), open_, assume_unique=True)
            ends.append((boxes.of(closed), node[closed]))
        if not len(open_):
            break
        node, total, boxes = node[open_], total[:, open_], boxes.of(open_)
        gains, column, cut, missing, left = pair_splits(running, shape, boxes, total, how)
        ends.append((boxes.of(~gains), node[~gains]))
        at = node[gains]
        tree.feature[at], tree.bin[at], tree.missing_left[at] = columns[column], cut, missing
        boxes = boxes.children(np.flatnonzero(gains), column, cut, missing)
        node = np.stack([2 * at + 1, 2 * at + 2], axis=1).ravel()
        total = np.stack([left, total[:, gains] - left], axis=2).reshape(2, -1)
        if not len(node):
            break
    return tree, (Boxes.joined([b for b, _ in ends]), np.concatenate([n for _, n in ends]))


def cell_values(tree: Tree, columns: np.ndarray, bins_of: np.ndarray, depth: int) -> np.ndarray:
    """What the tree gives each of ``cells``."""
    if len(columns) != 2:
        return tree.value[tree.leaves(cells(len(bins_of), columns, bins_of), depth)]
    shape = bins_of[columns]
    boxes, node = tree.leaves_of or leaf_boxes(tree, columns, shape)
    number, at = boxes.cells(np.arange(len(node)), shape)
    out = np.empty(shape.prod())
    out[at] = np.repeat(tree.value[node], number)
    return out


def leaf_boxes(tree: Tree, columns: np.ndarray, shape: np.ndarray) -> tuple[Boxes, np.ndarray]:
    """The leaves of a tree of two columns: their boxes and numbers."""
    node, boxes, ends = np.zeros(1, np.int64), Boxes.root(shape), []
    while len(node):
        split = tree.feature[node] >= 0
        ends.append((boxes.of(~split), node[~split]))
        node = node[split]
        boxes = boxes.children(np.flatnonzero(split), np.searchsorted(columns, tree.feature[node]), tree.bin[node].astype(np.int64), tree.missing_left[node])
        node = np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()
    return Boxes.joined([b for b, _ in ends]), np.concatenate([n for _, n in ends])


def grown(bins: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray, how: Boosting, shape: np.ndarray | None = None) -> Tree:
    """The tree of rows or cells with sums ``g`` and ``h`` of the derivatives; of two columns' whole grid of cells, its ``shape``."""
    if shape is not None:
        tree, tree.leaves_of = pair_grown(np.stack([g, h]), shape, columns, how)
        return tree
    if len(columns) == 2 and len(bins):
        bins_of = bins.max(0).astype(np.int64) + 1
        at, n = cell_of(bins, columns, bins_of), combinations(columns, bins_of)
        return pair_grown(np.stack([np.bincount(at, x, n) for x in (g, h)]), bins_of[columns], columns, how)[0]
    tree = Tree(how.depth)
    node = np.zeros(len(bins), np.int64)
    for level in range(how.depth + 1):
        first = (1 << level) - 1
        size = 1 << level
        total_g, total_h = (np.bincount(node - first, x, size) for x in (g, h))
        tree.value[first : first + size] = leaf_values(total_g, total_h, how)
        open_ = np.flatnonzero(total_h >= 2 * how.least * UNIT)
        if level == how.depth or not len(open_):
            break
        number = np.full(size, -1)
        number[open_] = np.arange(len(open_))
        place = number[node - first]
        inside = place >= 0
        gains, column, cut, missing = best_splits(histograms(place[inside], len(open_), bins[inside], columns, g[inside], h[inside]), how)
        at = first + open_[gains]
        tree.feature[at], tree.bin[at], tree.missing_left[at] = columns[column[gains]], cut[gains], missing[gains]
        further = tree.feature[node] >= 0
        node, g, h, bins = tree.step(bins[further], node[further]), g[further], h[further], bins[further]
        if not len(node):
            break
    return tree


def combinations(columns: np.ndarray, bins_of: np.ndarray) -> int:
    """How many combinations of bins a tree's columns can have."""
    return math.prod(bins_of[columns].tolist())


def cells(width: int, columns: np.ndarray, bins_of: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
    """Every combination of the bins of a tree's columns, the last changing first, or some of them; the other columns are 0."""
    some = np.arange(combinations(columns, bins_of)) if some is None else some
    out = np.zeros((len(some), width), np.uint8)
    out[:, columns] = np.stack(np.unravel_index(some, bins_of[columns]), axis=1)
    return out


def cell_of(bins: np.ndarray, columns: np.ndarray, bins_of: np.ndarray) -> np.ndarray:
    """The number in ``cells`` of each row's combination."""
    out = bins[:, columns[0]].astype(np.int64)
    for c in columns[1:]:
        out *= bins_of[c]
        out += bins[:, c]
    return out


def cell_sums(at: np.ndarray, n: int, rows: np.ndarray, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums (derivative, cell) of the rows picked."""
    own = at[rows]
    return np.stack([np.bincount(own, x, n) for x in gradients(margin[rows], y[rows])])


def cell_tree(sums: np.ndarray, columns: np.ndarray, bins_of: np.ndarray, how: Boosting, every: np.ndarray | None = None) -> Tree:
    """The tree of the cells' sums (derivative, cell); ``every`` are the cells, if they are at hand."""
    if len(columns) == 2:
        return grown(cells(len(bins_of), columns, bins_of) if every is None else every, columns, *sums, how, bins_of[columns])
    some = np.flatnonzero(sums.any(0))
    return grown(cells(len(bins_of), columns, bins_of, some), columns, *sums[:, some], how)


class Draws:
    """Which rows trees see, as ``sampled`` says, a piece at a time: what no tree changes is done once, and no piece needs memory of its own."""

    def __init__(self, row: np.ndarray, how: Boosting):
        self.how, self.limit = how, math.ceil(how.rows * float(1 << 53)) << 11
        self.row = row ^ (row >> _U(33))  # the first step of ``mixed``, which tells rows and salt apart
        self.x, self.shifted, self.salt = np.empty(PIECE, _U), np.empty(PIECE, _U), _U(0)

    def start(self, tree: int) -> None:
        salt = mixed(np.array([self.how.seed * 1_000_003 + tree + 1], _U))[0]
        self.salt = salt ^ (salt >> _U(33))

    def seen(self, p: slice) -> np.ndarray:
        row = self.row[p]
        if self.limit >= 1 << 64:
            return np.arange(len(row))
        x, shifted = self.x[: len(row)], self.shifted[: len(row)]
        np.bitwise_xor(row, self.salt, out=x)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x *= _U(factor)
            np.right_shift(x, _U(33), out=shifted)
            x ^= shifted
        return np.flatnonzero(x < _U(self.limit))


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, row: np.ndarray, how: Boosting) -> np.ndarray:
    """Margins of rows (bins, y, row number) under the trees of those with ``weight``."""
    margin = np.zeros(len(y))
    if not len(y):
        return margin
    bins_of, trained = bins.max(0).astype(np.int64) + 1, int(weight.sum())
    # those that train first, so that only they are drawn and need no look at their weight, and the outcomes of most pieces are one;
    # what the rows came as is let go, in a large set it is as much as all that is kept
    order = np.lexsort((y, ~weight)).astype(np.uint32 if len(y) < 1 << 32 else np.int64)
    draws = Draws(row.astype(_U, copy=False)[order[:trained]], how)
    del row, weight
    bins, y = np.asfortranarray(bins[order]), y[order]
    pieces = [slice(i, min(i + PIECE, trained)) for i in range(0, trained, PIECE)]
    both = np.empty(PIECE, complex)  # the two derivatives side by side, so that they are added up in one go
    known: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
    value, last = np.zeros(1), np.zeros(len(y), np.uint16)  # the tree before, which the margins do not have yet
    for t in range(how.trees):
        columns = seen_columns(bins.shape[1], t, how)
        n = combinations(columns, bins_of)
        if n > min(CELLS, len(y)):
            margin += value.take(last)
            draws.start(t)
            mine = np.concatenate([p.start + draws.seen(p) for p in pieces]) if pieces else np.zeros(0, np.int64)
            tree = grown(bins[mine], columns, *gradients(margin[mine], y[mine]), how)
            value, last = tree.value, tree.leaves(bins, how.depth)
            continue
        if (key := tuple(columns)) not in known:
            if len(known) == KNOWN:
                known.clear()
            known[key] = cell_of(bins, columns, bins_of).astype(np.uint16), cells(len(bins_of), columns, bins_of)
        at, every = known[key]
        draws.start(t)
        found = np.zeros(n, complex)
        for p in pieces:
            margin[p] += value.take(last[p].astype(np.intp))
            mine = draws.seen(p)
            one, own = y[p.start] == y[p.stop - 1], both[: len(mine)]
            own.real, own.imag = gradients(margin[p].take(mine), y[p.start] if one else y[p].take(mine))
            np.add.at(found, at[p].astype(np.intp).take(mine), own)
        margin[trained:] += value.take(last[trained:].astype(np.intp))
        tree = cell_tree(np.stack([found.real, found.imag]), columns, bins_of, how, every)
        value, last = cell_values(tree, columns, bins_of, how.depth), at
    out = np.empty(len(y))
    out[order] = margin + value.take(last)
    return out


# --- rows


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """At most ``BINS`` - 2 rising limits per feature, from quantiles over all rows; a value belongs above the limits that it reaches."""
    shares = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 100_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted({v for v in (found[f"q{i}"] or []) if v == v}) for i in range(len(features))]


def _binned(edges: list[list[float]]):
    """Rows (model, row, draw, y, train, x0, x1, ..) with their bins, one byte each, and a margin of 0."""
    limits = [np.array(e) for e in edges]
    kept = ["model", "row", "draw", "y", "train"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            packed = np.zeros((batch.num_rows, len(limits)), np.uint8)
            for i, e in enumerate(limits):
                x = batch.column(len(kept) + i).to_numpy(zero_copy_only=False).astype(np.float64)
                packed[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "right"))
            bins = pa.array([r.tobytes() for r in packed], pa.binary())
            yield pa.record_batch([*map(batch.column, kept), bins, pa.array(np.zeros(len(packed)))], names=[*kept, "bins", "margin"])

    return run


def _bytes(column) -> np.ndarray:
    """The bytes of a column of binaries, one behind the other."""
    parts = [c for c in getattr(column, "chunks", [column]) if len(c)]
    if not parts:
        return np.zeros(0, np.uint8)
    ends = [np.frombuffer(c.buffers()[1], np.int32)[[c.offset, c.offset + len(c)]] for c in parts]
    return np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[a:b] for c, (a, b) in zip(parts, ends, strict=True)])


class _Rows:
    """Columns of a table or batch of binned rows."""

    def __init__(self, table, width: int):
        self.bins, self.y, self.train, self.draw = _learnt(table, width)
        self.margin = table.column("margin").to_numpy().copy()


def _learnt(table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, outcomes, whether they train and draws of a table or batch of binned rows."""
    y = table.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
    train = table.column("train").to_numpy(zero_copy_only=False).astype(bool) & ~np.isnan(y)
    return _bytes(table.column("bins")).reshape(-1, width), np.nan_to_num(y), train, table.column("draw").to_numpy().view(_U)


def _whole_sets(width: int, how: Boosting, unseen: bool):
    """Margins of all rows of one set, or of those that do not train."""

    def run(table: pa.Table) -> pa.Table:
        # no name is given to the arrays, so that they are let go as the trees need them no more
        found = pa.table({"row": table.column("row"), "margin": pa.array(grow(*_learnt(table, width), how))})
        return found.filter(pc.invert(table.column("train"))) if unseen else found

    return run


class _Trees:
    """Trees (tree, set) since the rows were written, and what they add to the margins; made anew in each task."""

    def __init__(self, trees: list[list[Tree]], before: int, how: Boosting, bins_of: np.ndarray):
        self.trees, self.before, self.how, self.bins_of = trees, before, how, bins_of
        self.values: dict[tuple[int, int], np.ndarray] = {}

    def added(self, i: int, s: int, bins: np.ndarray) -> np.ndarray:
        tree, width = self.trees[i][s], len(self.bins_of)
        columns = seen_columns(width, self.before + i, self.how)
        if combinations(columns, self.bins_of) > CELLS:
            return tree.value[tree.leaves(bins, self.how.depth)]
        if (i, s) not in self.values:
            self.values[i, s] = cell_values(tree, columns, self.bins_of, self.how.depth)
        return self.values[i, s][cell_of(bins, columns, self.bins_of)]

    def margins(self, rows: _Rows, sets: np.ndarray) -> np.ndarray:
        margin = rows.margin
        for s in np.unique(sets):
            own = np.flatnonzero(sets == s)
            bins, sums = rows.bins[own], margin[own]
            for i in range(len(self.trees)):
                sums += self.added(i, s, bins)
            margin[own] = sums
        return margin


def _cell_sums(width: int, how: Boosting, t: int, trees: _Trees, sets: int):
    """Per task: sums of the derivatives per (set, cell)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = seen_columns(width, t, how)
        n = combinations(columns, trees.bins_of)
        sums = np.zeros((2, sets * n))
        for batch in stream:
            rows, own = _Rows(batch, width), batch.column("set").to_numpy().astype(np.int64)
            margin = trees.margins(rows, own)
            mine = np.flatnonzero(rows.train & sampled(rows.draw, t, how))
            sums += cell_sums(own * n + cell_of(rows.bins, columns, trees.bins_of), sets * n, mine, margin, rows.y)
        some = np.flatnonzero(sums.any(0))
        yield pa.record_batch([pa.array(x) for x in (some // n, some % n, *sums[:, some])], names=["set", "cell", "g", "h"])

    return run


def _cells_grown(width: int, how: Boosting, t: int, bins_of: np.ndarray):
    """The tree of one set from the sums of its cells."""

    def run(table: pa.Table) -> pa.Table:
        columns = seen_columns(width, t, how)
        sums = np.zeros((2, combinations(columns, bins_of)))
        sums[:, table.column("cell").to_numpy()] = [table.column(c).to_numpy() for c in ("g", "h")]
        tree = cell_tree(sums, columns, bins_of, how)
        parts = {"feature": tree.feature.astype(np.int32), "bin": tree.bin.astype(np.int32), "missing_left": tree.missing_left, "value": tree.value}
        return pa.table({"set": table.column("set").slice(0, 1)} | {k: pa.array([v.tolist()], pa.list_(pa.array(v[:0]).type)) for k, v in parts.items()})

    return run


def _level_sums(width: int, how: Boosting, t: int, level: int, trees: _Trees, current: list[Tree]):
    """Per task: sums of the derivatives per (set, node of the level, column, bin); column -1 has the node's totals."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, first, size = seen_columns(width, t, how), (1 << level) - 1, 1 << level
        held = None
        for batch in stream:
            rows, sets = _Rows(batch, width), batch.column("set").to_numpy()
            margin = trees.margins(rows, sets)
            mine = np.flatnonzero(rows.train & sampled(rows.draw, t, how))
            sets, bins = sets[mine].astype(np.int64), rows.bins[mine]
            g, h = gradients(margin[mine], rows.y[mine])
            node = np.zeros(len(mine), np.int64)
            for s in np.unique(sets):
                own = np.flatnonzero(sets == s)
                for _ in range(level):
                    node[own] = current[s].step(bins[own], node[own])
            there = node >= first  # others have stopped in a leaf
            place = (sets * size + node - first)[there]
            n = size * len(current)
            sums = [np.bincount(place, x[there], n) for x in (g, h)]
            parts = [np.stack(sums, axis=1).reshape(-1)]
            if level < how.depth:
                parts += [histograms(place, n, bins[there], columns[i : i + 1], g[there], h[there]).reshape(-1) for i in range(len(columns))]
            held = parts if held is None else [a + b for a, b in zip(held, parts, strict=True)]
        if held is None:
            return
        for i, sums in enumerate(held):
            sums = sums.reshape(size * len(current), -1, 2)
            place, cell = np.nonzero((sums != 0).any(2))
            column = np.full(len(place), -1 if i == 0 else columns[i - 1])
            yield pa.record_batch(
                [pa.array(x) for x in (place // size, place % size, column.astype(np.int64), cell, sums[place, cell, 0], sums[place, cell, 1])],
                names=["set", "node", "column", "bin", "g", "h"],
            )

    return run


def _chosen(width: int, how: Boosting, t: int, level: int):
    """The split of one node from its sums."""

    def run(table: pa.Table) -> pa.Table:
        columns = seen_columns(width, t, how)
        column, cell, g, h = (table.column(c).to_numpy() for c in ("column", "bin", "g", "h"))
        total = column < 0
        found, split = [g[total].sum(), h[total].sum()], (False, 0, 0, False)
        if level < how.depth and found[1] >= 2 * how.least * UNIT:
            sums = np.zeros((1, len(columns), BINS, 2))
            sums[0, np.searchsorted(columns, column[~total]), cell[~total]] = np.stack([g, h], axis=1)[~total]
            gains, c, cut, missing = best_splits(sums, how)
            split = (bool(gains[0]), int(columns[c[0]]), int(cut[0]), bool(missing[0]))
        names = ["set", "node", "g", "h", "split", "column", "bin", "missing_left"]
        return pa.table([pa.array([v]) for v in (table.column("set")[0].as_py(), table.column("node")[0].as_py(), *map(float, found), *split)], names=names)

    return run


def _applied(width: int, trees: _Trees):
    """The same rows with their margins under the trees since."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            margin = trees.margins(_Rows(batch, width), batch.column("set").to_numpy())
            yield pa.record_batch([batch.column(c) if c != "margin" else pa.array(margin) for c in batch.schema.names], names=batch.schema.names)

    return run


def _tree_by_cells(rows: DataFrame, current: list[Tree], width: int, how: Boosting, t: int, trees: _Trees) -> None:
    """Grows the next tree of each set from one exchange of its cells."""
    parts = rows.mapInArrow(_cell_sums(width, how, t, trees, len(current)), "set bigint, cell bigint, g double, h double")
    sums = parts.groupBy("set", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    schema = "set bigint, feature array<int>, bin array<int>, missing_left array<boolean>, value array<double>"
    for n in sums.groupBy("set").applyInArrow(_cells_grown(width, how, t, trees.bins_of), schema).collect():  # a tree a set
        tree = current[n["set"]]
        tree.feature[:], tree.bin[:], tree.missing_left[:], tree.value[:] = n["feature"], n["bin"], n["missing_left"], n["value"]


def _tree_by_levels(rows: DataFrame, current: list[Tree], width: int, how: Boosting, t: int, trees: _Trees) -> None:
    """Grows the next tree of each set level by level, an exchange each."""
    for level in range(how.depth + 1):
        parts = rows.mapInArrow(_level_sums(width, how, t, level, trees, current), "set bigint, node bigint, column bigint, bin bigint, g double, h double")
        sums = parts.groupBy("set", "node", "column", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        nodes = sums.groupBy("set", "node").applyInArrow(
            _chosen(width, how, t, level), "set bigint, node bigint, g double, h double, split boolean, column bigint, bin bigint, missing_left boolean"
        )
        found = nodes.collect()  # at most 2^depth rows a set
        first = (1 << level) - 1
        for n in found:
            tree, at = current[n["set"]], first + n["node"]
            tree.value[at] = leaf_values(n["g"], n["h"], how)
            if n["split"]:
                tree.feature[at], tree.bin[at], tree.missing_left[at] = n["column"], n["bin"], n["missing_left"]
        if not any(n["split"] for n in found):
            break


def _grow_together(rows: DataFrame, sets: int, bins_of: np.ndarray, how: Boosting, unseen: bool) -> DataFrame:
    """(row, margin) of rows of large sets, numbered in ``set``, or of those rows that do not train."""
    schema, width = rows.schema, len(bins_of)
    trees: list[list[Tree]] = []
    for t in range(how.trees):
        current, since = [Tree(how.depth) for _ in range(sets)], _Trees(trees, t - len(trees), how, bins_of)
        grow_next = _tree_by_cells if combinations(seen_columns(width, t, how), bins_of) <= CELLS else _tree_by_levels
        grow_next(rows.filter("train").drop("row"), current, width, how, t, since)
        trees.append(current)
        if len(trees) == BLOCK or t + 1 == how.trees:
            since = _Trees(trees, t + 1 - len(trees), how, bins_of)
            rows = durable(rows.mapInArrow(_applied(width, since), schema), "boosting-rows")
            trees = []
    return (rows.filter("not train") if unseen else rows).select("row", "margin")


def _dealt(rows: DataFrame, sizes: DataFrame) -> GroupedData:
    """Rows of the sets that are not large, grouped by set.

    They are few bytes but much work, so each set is a task of its own, the largest first; only of more than ``SETS_APART`` do some share one.
    """
    small, sets = sizes.filter("not large"), sizes.count()
    rows = rows.drop("margin")  # none yet
    if sets > SETS_APART:
        return group_join(rows, small.select("model"), ["model"], spread=["row"]).repartition(SETS_APART, "model").groupBy("model")
    placed = small.select("model", (F.row_number().over(Window.orderBy(F.desc("n"), "model")) - 1).alias("place"))
    return group_join(rows, placed, ["model"], spread=["row"]).drop("model").repartitionById(max(1, sets), "place").groupBy("place")


def boosted(members: DataFrame, model: str, key: Sequence[str], label: str, features: Sequence[str], train: str, how: Boosting = Boosting(), out: str = "p") -> DataFrame:
    """Adds ``out`` to rows (model, key.., label, train, features..): the probability under the trees of the set's rows where ``train`` is true.

    ``key`` decides which trees see a row.  A row without an outcome trains nothing but is scored; in a set without training rows, or where
    no split gains, all rows get what the outcome rate comes to.  A missing model value is a set like any other; no rows give none.
    """
    kept = durable(members.withColumn("_row", F.monotonically_increasing_id()), "boosting-members")
    trains = F.coalesce(F.col(train), F.lit(False))
    rows, bins_of = _cut(kept.select(F.col(model).alias("model"), F.col("_row").alias("row"), *_inputs(key, label), trains.alias("train"), *_values(features)))
    chances = _margins(rows, bins_of, how).select(F.col("row").alias("_row"), _chance().alias("_p"))
    return kept.join(chances.hint("shuffle_hash"), "_row").withColumn(out, F.col("_p")).drop("_row", "_p")


def fold_sets(rows: DataFrame, fold: str, k: int, key: Sequence[str], label: str, features: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """Rows cut into bins of k sets with one of the folds 0..k-1 left out of each, for ``boosted_folds``; they are written once, not once a set."""
    own = F.struct(*dict.fromkeys([*key, fold, label]))
    cut, bins_of = _cut(rows.select(F.col(fold).alias("model"), own.alias("row"), *_inputs(key, label), F.lit(True).alias("train"), *_values(features)), k)
    held = cut.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("train", F.col("held") != F.col("model"))
    return held.filter("train is not null").withColumn("model", F.col("held")).drop("held"), bins_of


def boosted_folds(sets: DataFrame, bins_of: np.ndarray, how: Boosting = Boosting(), out: str = "p") -> DataFrame:
    """Rows (key.., fold, label, ``out``): the probability of each row under the trees of the other folds' rows.

    These are the trees that ``boosted`` grows of the same sets, but each row comes back once, from the set that it does not train, with what is asked
    of it, so that no join follows.
    """
    return _margins(sets, bins_of, how, unseen=True).select("row.*", _chance().alias(out))


def _inputs(key: Sequence[str], label: str) -> list[Column]:
    return [F.xxhash64(*key).alias("draw"), F.col(label).cast("double").alias("y")]


def _values(features: Sequence[str]) -> list[Column]:
    return [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]


def _chance() -> Column:
    return 1 / (1 + F.exp(-F.col("margin")))


def _cut(slim: DataFrame, copies: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Rows (model, row, draw, y, train, x0, x1, ..) with their bins, written, and the number of bins of each feature.

    ``copies`` is how often the sets have each row: quantiles are approximate, and those of a few repeated rows are not quite those of the rows.
    Of more than ``MANY`` rows they depend on how these lie in the files by as much, and none is repeated.
    """
    values = slim.columns[5:]
    repeated = copies > 1 and slim.count() <= MANY
    edges = bin_edges(slim.select(*values, F.explode(F.sequence(F.lit(1), F.lit(copies)))) if repeated else slim, values)
    schema = T.StructType([*slim.drop(*values).schema.fields, T.StructField("bins", T.BinaryType()), T.StructField("margin", T.DoubleType())])
    return durable(slim.mapInArrow(_binned(edges), schema), "boosting-rows"), np.array([len(e) + 2 for e in edges])


def _margins(rows: DataFrame, bins_of: np.ndarray, how: Boosting, unseen: bool = False) -> DataFrame:
    """(row, margin) of the binned rows under the trees of their set, or of those that do not train."""
    width = len(bins_of)
    sizes = durable(rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * width > TASK_CELLS).alias("large")), "boosting-sizes")
    schema = T.StructType([rows.schema["row"], T.StructField("margin", T.DoubleType())])
    parts = [_dealt(rows, sizes).applyInArrow(_whole_sets(width, how, unseen), schema)]
    wide = [r["model"] for r in sizes.filter("large").collect()]  # as many as the cells allow, whatever the number of sets
    for i in range(0, len(wide), TOGETHER):
        own = wide[i : i + TOGETHER]
        number = F.coalesce(*[F.when(F.col("model").eqNullSafe(F.lit(w)), F.lit(j)) for j, w in enumerate(own)])
        together = durable(rows.withColumn("set", number).filter("set is not null").drop("model"), "boosting-large")
        parts.append(_grow_together(together, len(own), bins_of, how, unseen))
    return durable(reduce(DataFrame.unionByName, parts), "boosting-margins")
