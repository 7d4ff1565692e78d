"""Decision trees grown level by level over binned blocks, many at once.

*Members* are the trees grown together: those of a forest, of all folds of a
search, or the classes of a boosting round. A level is one pass over the blocks
for all of them: every task sums histograms by (member, node, feature, bin)
over its blocks, they are summed by (member, node), and the best cut of each
node (one small row) reaches the driver, which opens the children. A node of at
most ``LOCAL`` rows is not split over the network any further: its rows meet in
one group, where the rest of its tree is grown. Both ways judge cuts by the
same function, so the tree does not depend on where a node is finished.

A row's statistics are ``[rows, G, H]``: for variance G is the weighted target
and H the weight, for second-order boosting they are gradient and Hessian
sums. With ``gini`` they are ``[rows, weight of each class]``. Ties go to the
first feature, the lowest cut, and missing values to the right.
"""

from __future__ import annotations

import copy
import heapq
import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from fathom.plans.binned import BINS, MISSING, Binned, blocks_in
from fathom.session import written

#: Rows of a node that one task finishes, and bytes of histograms that a task holds.
LOCAL, HELD = 1 << 16, 1 << 26
#: Parts of a large table that such a node may hold one of, and its rows at most: histograms grow with the tasks, not with tasks times nodes.
NODES, MOST_LOCAL = 512, 1 << 20
#: Most nodes of a tree whose steps are looked up in a table; columns that are sent down a tree, or counted, at once (they stay in a core's cache).
LOOKUP, AT_ONCE = 512, 1 << 15
#: Most inner nodes whose conditions are all tried on every column.
MASKS = 32
#: Gains closer than this part of the larger are equal.
NEAR = 1e-10
_U = np.uint64


def mix(h):
    """64 bits of which each depends on every bit of h."""
    h = np.asarray(h, np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def root_path(tree: int, seed: int) -> np.uint64:
    return mix(mix(seed) ^ _U(tree + 1))


def child_paths(path, side: int):
    with np.errstate(over="ignore"):
        return mix(np.asarray(path, np.uint64) * _U(2) + _U(side + 1))


def signed(path) -> int:
    """A path as a signed integer."""
    return int(np.asarray(path, np.uint64).view(np.int64))


def draws(path, feature: int) -> np.ndarray:
    """A uniform number for each node (by its path) and a feature."""
    return (mix(np.asarray(path, np.uint64) ^ _U((feature + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(11)).astype(float) / 2 ** 53


@dataclass
class Rule:
    """How nodes are split and leaves valued."""
    kind: str = "newton"            # or gini
    classes: int = 0
    penalty: float = 0.0            # added to H in gains and leaves
    extra: bool = False             # a fourth statistic that divides G in leaves
    max_depth: int | None = None
    min_split: int = 2              # rows of a node that is split
    min_rows: float = 1             # rows of a child
    min_weight: float = 0.0         # H of a child
    min_gain: float | None = None   # None: any valid cut of a node that is not pure
    max_features: int | None = None
    random_cuts: bool = False       # one random cut for each node and feature
    splits: int | None = None       # splits of a tree that are used, the best first
    spread: bool = True             # sums of G^2/H are kept, which tell pure nodes

    @property
    def width(self) -> int:
        """Statistics of a node: rows, then G, H, G^2/H (if ``spread``) and the extra one, or the classes."""
        return 1 + self.classes if self.kind == "gini" else 3 + self.spread + self.extra

    def expand(self, sent: np.ndarray) -> np.ndarray:
        """Statistics of rows from what is sent of them: [rows, G, H, (extra)] or [rows, weight, class]."""
        if self.kind == "gini":
            out = np.zeros((len(sent), self.width))
            out[:, 0] = sent[:, 0]
            out[np.arange(len(sent)), 1 + sent[:, 2].astype(int)] = sent[:, 1]
            return out
        if not self.spread:
            return sent
        with np.errstate(all="ignore"):
            q = np.where(sent[:, 2] > 0, sent[:, 1] ** 2 / sent[:, 2], 0.0)
        return np.column_stack([sent[:, :3], q, sent[:, 3:]])

    def score(self, t: np.ndarray) -> np.ndarray:
        if self.kind == "gini":
            w = t[..., 1:].sum(-1)
            return (t[..., 1:] ** 2).sum(-1) / np.where(w > 0, w, 1.0)
        h = t[..., 2] + self.penalty if self.penalty else t[..., 2]
        return t[..., 1] ** 2 / (h if h.size and h.min() > 0 else np.where(h > 0, h, 1.0))

    def leaf(self, t: np.ndarray) -> np.ndarray:
        """(nodes, values)."""
        t = np.atleast_2d(t)
        if self.kind == "gini":
            w = t[:, 1:].sum(-1, keepdims=True)
            return t[:, 1:] / np.where(w > 0, w, 1.0)
        below = t[:, -1] if self.extra else t[:, 2] + self.penalty
        with np.errstate(all="ignore"):
            return np.where(np.abs(below) > 1e-150, t[:, 1] / below, 0.0)[:, None]

    def closed(self, t: np.ndarray, depth: int) -> np.ndarray:
        """Nodes that are not split."""
        t = np.atleast_2d(t)
        stop = (t[:, 0] < self.min_split) | (t[:, 0] < 2 * self.min_rows)
        if self.max_depth is not None and depth >= self.max_depth:
            stop |= True
        if self.min_gain is None:
            if self.kind == "gini":
                stop |= (t[:, 1:] > 0).sum(-1) <= 1
            else:
                stop |= t[:, 3] - self.score(t) <= 1e-13 * t[:, 3]
        elif self.kind != "gini":
            stop |= t[:, 2] < 2 * self.min_weight
        return stop

    def first_features(self, path, d: int) -> np.ndarray:
        """(nodes, features): every node's features in the order in which they are tried."""
        path = np.atleast_1d(path)
        if self.max_features is None or self.max_features >= d:
            return np.tile(np.arange(d), (len(path), 1))
        return np.argsort(np.stack([draws(path ^ _U(0x5851F42D4C957F2D), f) for f in range(d)], 1), axis=1, kind="stable")


class Best:
    """The best cut of each node so far."""

    def __init__(self, n: int):
        self.gain, self.feature = np.full(n, -np.inf), np.full(n, -1, np.int32)
        self.cut, self.missing_left = np.zeros(n, np.uint8), np.zeros(n, bool)

    def offer(self, node, gain, f: int, cut, missing_left, scale):
        better = gain > self.gain[node] + NEAR * np.maximum(scale, np.abs(gain))
        at = node[better]
        self.gain[at], self.feature[at] = gain[better], f
        self.cut[at], self.missing_left[at] = cut[better], missing_left[better]


def judge(best: Best, f: int, node: np.ndarray, bins: np.ndarray, s: np.ndarray, total: np.ndarray, rule: Rule,
          path: np.ndarray, stands: np.ndarray) -> None:
    """Offers the cuts of feature f to ``best``: rows sorted by (node, bin), their statistics, and the nodes' totals."""
    if not len(node):
        return
    key = node.astype(np.int64) * BINS + bins
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    judge_sums(best, f, node[start], bins[start].astype(np.int64), np.add.reduceat(s, start, axis=0), total, rule, path, stands)


def judge_sums(best: Best, f: int, node: np.ndarray, bins: np.ndarray, sums: np.ndarray, total: np.ndarray, rule: Rule,
               path: np.ndarray, stands: np.ndarray) -> None:
    """The same from the sums of each (node, bin), in their order."""
    # cumulative statistics inside each node
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    columns = np.ascontiguousarray(sums.T)                                   # a statistic's values lie side by side
    upto = np.cumsum(columns, axis=1)
    size = np.diff(np.append(first, len(node)))
    upto -= np.repeat(upto[:, first] - columns[:, first], size, axis=1)
    last = first + size - 1
    some_missing = bins[last] == MISSING
    if rule.random_cuts:
        top = last - some_missing
        ok = top > first                                                     # several values
        low, high, of = stands[bins[first[ok]]], stands[np.minimum(bins[top[ok]], len(stands) - 1)], node[first[ok]]
        with np.errstate(all="ignore"):
            value = low + draws(path[of], f) * (high - low)
        cut = np.clip(np.searchsorted(stands, value, side="right") - 1, bins[first[ok]], bins[top[ok]] - 1)
        at = np.searchsorted(node * BINS + bins, of * BINS + cut, side="right") - 1
        # nodes whose only cut is between values and missing ones
        only = np.flatnonzero(some_missing & (top == first))
        at, cut = np.concatenate((at, first[only])), np.concatenate((cut, bins[first[only]]))
        order = np.argsort(node[at], kind="stable")
        at, cut = at[order], cut[order]
    else:
        between = np.ones(len(node), bool)
        between[last] = False
        at = np.flatnonzero(between)                                           # between two bins of a node
        cut = bins[at]
    if not len(at):
        return
    of, left = node.take(at), upto.take(at, axis=1).T
    whole = np.ascontiguousarray(total.T).take(of, axis=1).T
    parents = rule.score(total)
    parent = parents.take(of)

    def gains(a, all_ok=False):
        b = whole - a
        g = rule.score(a) + rule.score(b) - parent
        if all_ok:
            return g
        bad = (a[:, 0] < rule.min_rows) | (b[:, 0] < rule.min_rows)
        if rule.kind != "gini":
            bad |= (a[:, 2] < rule.min_weight) | (b[:, 2] < rule.min_weight)
        return np.where(bad, -np.inf, g)
    # both sides of a cut between two bins have a row
    gain, side = gains(left, rule.min_rows <= 1 and rule.min_weight <= 0 and not rule.random_cuts), np.zeros(len(at), bool)
    if some_missing.any():
        missing = np.zeros_like(total)
        missing[node[last[some_missing]]] = sums[last[some_missing]]
        other = gains(left + missing[of])
        with np.errstate(all="ignore"):
            better = other > gain + NEAR * np.maximum(np.abs(parent), np.abs(other))
        if rule.random_cuts:
            better = draws(path[of] ^ _U(0x2545F4914F6CDD1D), f) < 0.5
        gain, side = np.where(better, other, gain), better
    # the first of the (nearly) best cuts of each node
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    top, own = np.maximum.reduceat(gain, first), of[first]
    with np.errstate(all="ignore"):
        least = top - NEAR * np.maximum(np.abs(parents[own]), np.abs(top))
        near = np.flatnonzero((gain >= np.repeat(least, np.diff(first, append=len(of)))) & (gain > -np.inf))
    pick = near[np.concatenate(([True], of[near][1:] != of[near][:-1]))] if len(near) else near
    scale = np.abs(parent[pick])
    best.offer(of[pick], gain[pick], f, cut[pick], side[pick], scale)


def enough(best: Best, rule: Rule, total: np.ndarray) -> np.ndarray:
    """Nodes whose best cut is taken."""
    if rule.min_gain is None:
        return best.feature >= 0
    return (best.feature >= 0) & (best.gain > rule.min_gain)


# ------------------------------------------------------------------ trees as arrays
@dataclass
class Tree:
    """``feature`` is -1 in leaves; the right child follows the left one."""
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    rows: np.ndarray
    value: np.ndarray           # (nodes, values), of inner nodes too

    KINDS = (("feature", np.int16), ("cut", np.uint8), ("missing_left", np.uint8), ("left", np.int32), ("gain", np.float64), ("rows", np.float32))

    def packed(self, gain: bool = True) -> bytes:
        """The tree as bytes, without its gains where nothing is cut by them."""
        parts = [getattr(self, n).astype(t).tobytes() for n, t in self.KINDS if gain or n != "gain"] + [self.value.astype(np.float64).tobytes()]
        return np.array([*self.value.shape, gain], np.int64).tobytes() + b"".join(parts)

    @classmethod
    def unpacked(cls, data: bytes) -> "Tree":
        n, k, gain = np.frombuffer(data, np.int64, 3).tolist()
        at, out = 24, []
        for name, t in cls.KINDS:
            if name == "gain" and not gain:
                out.append(np.zeros(n))
                continue
            out.append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        return cls(*out, np.frombuffer(data[at:], np.float64).reshape(n, k))

    def step(self, node: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The children of inner nodes for the given rows (columns of bins)."""
        b = bins[self.feature[node], rows]
        left = np.where(b == MISSING, self.missing_left[node] != 0, b <= self.cut[node])
        return self.left[node] + ~left

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every column of bins."""
        if self._levels() is not None or (self.feature >= 0).sum() <= MASKS:
            return self._by_masks(bins)
        if len(self.feature) <= LOOKUP:
            return self._looked_up(bins)
        node = np.zeros(bins.shape[1], np.int32)
        live = np.flatnonzero(self.feature[node] >= 0)
        while len(live):
            node[live] = self.step(node[live], bins, live)
            live = live[self.feature[node[live]] >= 0]
        return node

    def _levels(self) -> np.ndarray | None:
        """The first node of each level of a full tree whose levels have one cut each; None for another tree."""
        n = len(self.feature)
        if n < 3 or n & (n + 1):
            return None
        inner = np.arange(n >> 1)
        first = (1 << np.int64(np.log2(inner + 1))) - 1                        # of each node's level
        same = all((a[inner] == a[first]).all() for a in (self.feature, self.cut, self.missing_left))
        return np.unique(first) if same and (self.left[inner] == 2 * inner + 1).all() and (self.feature[n >> 1:] < 0).all() \
            and (self.feature[inner] >= 0).all() else None

    def _goes_left(self, node: int, bins: np.ndarray) -> np.ndarray:
        left = bins[self.feature[node]] <= self.cut[node]
        return left | (bins[self.feature[node]] == MISSING) if self.missing_left[node] else left

    def _by_masks(self, bins: np.ndarray) -> np.ndarray:
        """The same by every inner node's condition on all columns: the children's results are put together, from the last node to the first."""
        levels, out = self._levels(), np.empty(bins.shape[1], np.int32)
        ends = np.flatnonzero(self.feature < 0)
        place = np.zeros(len(self.feature), np.uint8)
        place[ends] = np.arange(min(len(ends), 256)) if levels is None else 0
        for at in range(0, bins.shape[1], AT_ONCE):
            own = bins[:, at:at + AT_ONCE]
            if levels is not None:
                node = np.zeros(own.shape[1], np.int32)
                for first in levels.tolist():
                    node += node
                    node += 2
                    node -= self._goes_left(first, own)
                out[at:at + AT_ONCE] = node
                continue
            held: dict = {}
            for n in np.flatnonzero(self.feature >= 0)[::-1].tolist():         # children come after their parents
                a, b = (held.pop(k, place[k]) for k in (int(self.left[n]), int(self.left[n]) + 1))
                held[n] = ((a ^ b) & -self._goes_left(n, own).view(np.uint8)) ^ b
            out[at:at + AT_ONCE] = ends[held[0]] if held else 0
        return out

    def _looked_up(self, bins: np.ndarray) -> np.ndarray:
        """The same by a table of (node, bin) -> next node, in which leaves lead to themselves."""
        nodes, n = np.arange(len(self.feature)), bins.shape[1]
        inner = np.flatnonzero(self.feature >= 0)
        goes = np.arange(BINS) <= self.cut[inner, None]
        goes[:, MISSING] = self.missing_left[inner] != 0
        to = np.repeat(nodes[:, None], BINS, axis=1)
        to[inner] = self.left[inner, None] + ~goes
        to, column = to.ravel() * BINS, np.maximum(self.feature, 0).astype(np.int64).repeat(BINS) * n
        flat, at, node = np.ascontiguousarray(bins).ravel(), np.arange(n), np.zeros(n, np.int64)      # node: its place in ``to``
        level = np.zeros(1, np.int64)
        while (level := level[self.feature[level] >= 0]).size:
            node = to.take(node + flat.take(column.take(node) + at))
            level = np.concatenate([self.left[level], self.left[level] + 1])
        return (node // BINS).astype(np.int32)

    def truncated(self, bins: np.ndarray, variants: list[tuple[int | None, int]], depth: int = 0, closed: np.ndarray | None = None):
        """For each (max_depth, min_split): the node where a row stops, as if the tree had been grown with them.

        ``depth`` is the depth of the first node."""
        n = bins.shape[1]
        node, out = np.zeros(n, np.int32), np.zeros((len(variants), n), np.int32)
        live, stopped = np.arange(n), np.zeros((len(variants), n), bool)
        while len(live):
            inner = self.feature[node[live]] >= 0
            for v, (most, least) in enumerate(variants):
                stop = ~inner | (self.rows[node[live]] < least) | (most is not None and depth >= most)
                new = live[stop & ~stopped[v, live]]
                out[v, new], stopped[v, new] = node[new], True
            live = live[inner & ~stopped[:, live].all(0)]
            node[live] = self.step(node[live], bins, live)
            depth += 1
        return out


class Growing:
    """A tree whose nodes are appended."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.feature, self.cut, self.missing_left, self.left, self.gain = [], [], [], [], []
        self.depth, self.path, self.total = [], [], []

    def add(self, depth: int, path: int, total: np.ndarray) -> int:
        for a, x in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.gain, 0.0),
                     (self.depth, depth), (self.path, path), (self.total, total)):
            a.append(x)
        return len(self.feature) - 1

    def split(self, node: int, gain, feature, cut, missing_left, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        self.gain[node], self.feature[node], self.cut[node], self.missing_left[node] = gain, feature, cut, missing_left
        kids = [self.add(self.depth[node] + 1, child_paths(self.path[node], side), t) for side, t in enumerate((left, right))]
        self.left[node] = kids[0]
        return tuple(kids)

    def tree(self) -> Tree:
        total = np.array(self.total).reshape(len(self.feature), -1)
        return Tree(np.array(self.feature, np.int32), np.array(self.cut, np.uint8), np.array(self.missing_left, np.uint8), np.array(self.left, np.int32),
                    np.array(self.gain, float), total[:, 0], self.rule.leaf(total))


# ------------------------------------------------------------------ a node's tree in one task
class Sums:
    """Sums of rows' statistics by (node, bin), one column after the other; a row of ``gini`` has the weight of one class.

    Equal columns are kept once, and a column of ones is not kept: the number of rows is its sum."""

    def __init__(self, rule: Rule, s: np.ndarray):
        self.classes, self.label, columns = 0, None, [np.ascontiguousarray(c) for c in s.T]
        if rule.kind == "gini" and rule.classes > 1 and ((s[:, 1:] != 0).sum(1) <= 1).all():
            self.classes, self.label = rule.classes, s[:, 1:].argmax(1)
            columns = [columns[0], s[:, 1:].sum(1)]
        self.columns, self.same = [], []
        for c in columns:
            at = next((i for i, x in enumerate(self.columns) if np.array_equal(x, c)), len(self.columns))
            self.columns += [c] if at == len(self.columns) else []
            self.same.append(at)
        self.columns = [None if (c == 1).all() else c for c in self.columns]
        self.judged = self.same if rule.kind == "gini" else self.same[:3]            # what cuts are judged by

    def kept(self, rows: np.ndarray) -> None:
        """Only these rows go on, in this order."""
        self.columns = [None if c is None else c.take(rows) for c in self.columns]
        self.label = None if self.label is None else self.label[rows]

    def some(self, rows: np.ndarray | None) -> "Sums":
        """The columns of these rows."""
        if rows is None:
            return self
        out = copy.copy(self)
        out.kept(rows)
        return out

    def where(self, mask: np.ndarray, starts: np.ndarray, node: np.ndarray) -> np.ndarray:
        """(nodes, statistics) of the rows in ``mask``; rows are in their nodes' order, which begin at ``starts``."""
        found = {k: np.add.reduceat(mask, starts, dtype=np.float64) if self.columns[k] is None else np.add.reduceat(self.columns[k] * mask, starts)
                 for k in set(self.judged[:1] if self.classes else self.judged)}
        if not self.classes:
            return np.stack([found[k] for k in self.judged], axis=1)
        weight = mask if self.columns[self.same[1]] is None else self.columns[self.same[1]] * mask
        return np.column_stack([found[self.same[0]], np.bincount(node * self.classes + self.label, weight, len(starts) * self.classes).reshape(-1, self.classes)])

    def totals(self, starts: np.ndarray, n: int) -> np.ndarray:
        """(nodes, statistics) of n rows in their nodes' order, which begin at ``starts``."""
        found = [np.diff(starts, append=n).astype(float) if c is None else np.add.reduceat(c, starts) for c in self.columns]
        return np.stack([found[k] for k in self.same], axis=1)

    def of(self, node: np.ndarray, bins: np.ndarray, nodes: int, values: int, rows: np.ndarray | None):
        """(node, bin, sums) of the (node, bin) that have rows, in their order. ``values`` bounds the bins but MISSING."""
        used = sorted(set(self.judged))
        columns = {k: c if c is None or rows is None else c.take(rows) for k in used for c in [self.columns[k]]}
        label = self.label if rows is None or self.label is None else self.label[rows]
        size, n = values + 1, len(node)
        code = node * size + np.minimum(bins, values)
        dense = nodes * size <= 4 * n + 1024
        if dense:
            count = np.bincount(code, minlength=nodes * size)
            found = np.flatnonzero(count)
            at, cells, take, count = code, nodes * size, found, count[found]
        else:
            # few rows for each node: their codes are sorted, each with the place of its row
            bits = n.bit_length()
            order = np.sort((code << bits) | np.arange(n))
            place, code = order & ((1 << bits) - 1), order >> bits
            start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            found, cells, take, count = code[start], len(start), slice(None), np.diff(start, append=n)
            at = np.repeat(np.arange(cells), count) if self.classes else None
            columns = {k: None if c is None else c.take(place) for k, c in columns.items()}
            label = None if label is None else label[place]

        def added(c):
            return count if c is None else np.bincount(at, c, cells)[take] if dense else np.add.reduceat(c, start)
        if self.classes:
            out = np.empty((1 + self.classes, len(found)))
            out[0] = added(columns[self.same[0]])
            out[1:] = np.bincount(at * self.classes + label, columns[self.same[1]], cells * self.classes).reshape(cells, self.classes)[take].T
        else:
            sums = {k: added(c) for k, c in columns.items()}
            out = np.stack([sums[k] for k in self.judged]).astype(float, copy=False)
        node, bins = np.divmod(found, size)
        return node, np.where(bins == values, MISSING, bins), out.T


def _taken(bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``bins[:, rows]``, one feature after the other."""
    out = np.empty((len(bins), len(rows)), np.uint8)
    for own, to in zip(bins, out):
        own.take(rows, out=to, mode="clip")
    return out


def judge_random(best: Best, f: int, own: np.ndarray, starts: np.ndarray, node: np.ndarray, bins: np.ndarray, sums: Sums, total: np.ndarray, rule: Rule,
                 path: np.ndarray, stands: np.ndarray) -> None:
    """As ``judge_sums`` for one random cut of each of the nodes ``own``: it lies between the node's least and greatest bin, and
    the rows on its left are added up, without the sums of all bins. Rows are in their nodes' order; ``node`` is a place in ``own``."""
    if not len(own):
        return
    missing = bins == MISSING
    some_missing = np.logical_or.reduceat(missing, starts)
    any_missing = bool(some_missing.any())
    low, high = np.minimum.reduceat(bins, starts), np.maximum.reduceat(np.where(missing, 0, bins) if any_missing else bins, starts)
    several, known = high > low, low != MISSING
    with np.errstate(all="ignore"):
        least, most = stands[np.minimum(low, len(stands) - 1)], stands[np.minimum(high, len(stands) - 1)]
        value = least + draws(path[own], f) * (most - least)
    cut = np.clip(np.searchsorted(stands, value, side="right") - 1, low, np.maximum(high.astype(np.int64) - 1, low))
    at = np.flatnonzero(known & (several | some_missing))                     # two values, or a value and missing ones
    if not len(at):
        return
    left = sums.where(bins <= cut.astype(np.uint8).take(node), starts, node)[at]
    of, cut, whole = own[at], cut[at], total[own[at]]
    parent = rule.score(whole)

    def gains(a):
        b = whole - a
        bad = (a[:, 0] < rule.min_rows) | (b[:, 0] < rule.min_rows)
        if rule.kind != "gini":
            bad |= (a[:, 2] < rule.min_weight) | (b[:, 2] < rule.min_weight)
        return np.where(bad, -np.inf, rule.score(a) + rule.score(b) - parent)
    gain, side = gains(left), np.zeros(len(at), bool)
    if any_missing:
        side = draws(path[of] ^ _U(0x2545F4914F6CDD1D), f) < 0.5
        gain = np.where(side, gains(left + sums.where(missing, starts, node)[at]), gain)
    ok = np.isfinite(gain)
    best.offer(of[ok], gain[ok], f, cut[ok], side[ok], np.abs(parent)[ok])


def grow_here(bins: np.ndarray, s: np.ndarray, rule: Rule, depth: int, path, stands: list[np.ndarray]) -> Tree:
    """The tree below a node: ``bins`` (features, rows), ``s`` (rows, statistics).

    With ``rule.splits`` a node is split only if best-first growth can come to it: it takes all splits whose least gain on the way
    from the first node is above a node's own before that node."""
    d, n = bins.shape
    values = [int(np.where(b == MISSING, 0, b).max(initial=0)) + 1 for b in bins]
    sums = Sums(rule, s)                                                            # what cuts are judged by
    wide = s.shape[1] if rule.kind == "gini" else 3
    s = s if sums.classes else None                                                 # else its columns are those of the sums
    parts = {k: [] for k in ("feature", "cut", "missing_left", "left", "gain", "total")}
    of = np.zeros(n, np.int64)                                                      # the node of each row; rows are in their nodes' order
    paths, made = np.atleast_1d(np.asarray(path, np.uint64)), 1
    least, known = np.full(1, np.inf), np.zeros(0)          # least gain on the way to each node; the greatest of those of all splits
    while len(of):
        m = len(paths)
        starts = np.searchsorted(of, np.arange(m))
        total = sums.totals(starts, len(of)) if s is None else np.add.reduceat(s, starts, axis=0)
        split = ~rule.closed(total, depth)
        best = Best(m)
        if not split.all():
            live = np.flatnonzero(split[of])
            of, bins, s = of.take(live), _taken(bins, live), None if s is None else s[live]
            sums.kept(live)
        size = np.bincount(of, minlength=m)
        begin = np.cumsum(size) - size
        ranks = np.cumsum(split) - 1
        tried = rule.first_features(paths, d)
        most = tried.shape[1] if rule.max_features is None else min(rule.max_features, d)
        for rank in [range(most), *([r] for r in range(most, d))]:
            # beyond the first features only nodes without any cut go on
            open_ = split & ((best.feature < 0) | (rank == range(most)))
            if not open_.any():
                break
            uses = np.zeros((m, d), bool)
            uses[np.repeat(np.flatnonzero(open_), len(rank)), tried[open_][:, list(rank)].ravel()] = True
            some = not uses[open_].all()
            for f in np.flatnonzero(uses.any(0)).tolist():
                if some:
                    own = np.flatnonzero(uses[:, f])                            # the nodes that try it, numbered anew
                    node = np.repeat(np.arange(len(own)), size[own])
                    rows = np.arange(len(node)) + (begin[own] - np.cumsum(size[own]) + size[own])[node]
                if rule.random_cuts:
                    own, node, b, rows = (own, node, bins[f].take(rows), rows) if some else (np.flatnonzero(split), ranks[of], bins[f], None)
                    judge_random(best, f, own, np.cumsum(size[own]) - size[own], node, b, sums.some(rows), total[:, :wide], rule, paths, stands[f])
                elif some:
                    node, *found = sums.of(node, bins[f, rows], len(own), values[f], rows)
                    judge_sums(best, f, own[node], *found, total[:, :wide], rule, paths, stands[f])
                else:
                    judge_sums(best, f, *sums.of(of, bins[f], m, values[f], None), total[:, :wide], rule, paths, stands[f])
        taken = split & enough(best, rule, total)
        if rule.splits is not None:
            least = np.minimum(least, best.gain)
            known = np.sort(np.concatenate((known, least[taken])))[-rule.splits:] if rule.splits else known
            taken &= least >= (known[0] if len(known) == rule.splits > 0 else -np.inf if rule.splits else np.inf)
            least = np.repeat(least[taken], 2)
        place = np.cumsum(taken) - 1
        left = np.where(taken, made + 2 * place, 0)
        for k, x in (("feature", np.where(taken, best.feature, -1)), ("cut", best.cut), ("missing_left", best.missing_left), ("left", left),
                     ("gain", np.where(taken, best.gain, 0.0)), ("total", total)):
            parts[k].append(x)
        live = np.flatnonzero(taken[of])
        b = bins[best.feature[of[live]], live]
        goes_left = np.where(b == MISSING, best.missing_left[of[live]], b <= best.cut[of[live]])
        node = 2 * place[of[live]] + ~goes_left
        order = np.argsort(node.astype(np.uint16 if m <= 1 << 15 else np.int64), kind="stable")
        live, of = live[order], node[order]
        bins, s = _taken(bins, live), None if s is None else s[live]
        sums.kept(live)
        paths = np.stack([child_paths(paths[taken], 0), child_paths(paths[taken], 1)], 1).ravel()
        made += 2 * int(taken.sum())
        depth += 1
    whole = {k: np.concatenate(v) for k, v in parts.items()}
    total = whole.pop("total")
    return Tree(whole["feature"].astype(np.int32), whole["cut"], whole["missing_left"].astype(np.uint8), whole["left"].astype(np.int32), whole["gain"],
                total[:, 0], rule.leaf(total))


# ------------------------------------------------------------------ a tree of few nodes in one task
class Counts:
    """Sums of rows by (node, bin) of all features: ``bins`` (features, rows), where missing values have the last of a feature's
    ``sizes``, and statistics, of which equal ones are counted once."""

    def __init__(self, bins: np.ndarray, sizes: np.ndarray, columns: list[np.ndarray]):
        self.sizes, self.offset = sizes, np.concatenate(([0], np.cumsum(sizes)))
        self.bins = np.minimum(bins, (sizes - 1).astype(np.uint8)[:, None])
        self.own, self.same = [], []
        for c in columns:
            at = next((i for i, x in enumerate(self.own) if x is c or np.array_equal(x, c)), len(self.own))
            self.own += [np.ascontiguousarray(c)] if at == len(self.own) else []
            self.same.append(at)
        self.ones = [bool((c == 1).all()) for c in self.own]
        self.judged = self.same[:3]                                             # what cuts are judged by

    def of(self, node: np.ndarray, nodes: int, rows: np.ndarray | None = None) -> np.ndarray:
        """(nodes, bins of all features, the first three statistics) of ``rows`` (all) and the node of each."""
        out = {k: np.zeros((nodes, int(self.offset[-1]))) for k in self.judged}
        step = max(AT_ONCE, 4 * nodes * 256)
        kind = np.uint16 if nodes * 256 <= 1 << 16 else np.int64               # of (node, bin)
        for at in range(0, len(node), step):
            base = node[at:at + step].astype(kind)
            own = (lambda x: x[at:at + step]) if rows is None else (lambda x, which=rows[at:at + step]: x.take(which))
            weights = {k: None if self.ones[k] else own(self.own[k]) for k in out}
            for f, size in enumerate(self.sizes.tolist()):
                code = own(self.bins[f]) if nodes == 1 else base * kind(size) + own(self.bins[f])
                for k, w in weights.items():
                    out[k][:, self.offset[f]:self.offset[f + 1]] += np.bincount(code, w, nodes * size).reshape(nodes, size)
        return np.stack([out[k] for k in self.judged], axis=-1)

    def totals(self, node: np.ndarray, nodes: int, rows: np.ndarray | None = None) -> np.ndarray:
        """(nodes, statistics)."""
        out = np.zeros((len(self.own), nodes))
        for at in range(0, len(node), AT_ONCE):
            which = slice(at, at + AT_ONCE) if rows is None else rows[at:at + AT_ONCE]
            for k, c in enumerate(self.own):
                out[k] += np.bincount(node[at:at + AT_ONCE], None if self.ones[k] else c[which] if rows is None else c.take(which), nodes)
        return out[self.same].T

    def children(self, of: np.ndarray, rows: np.ndarray | None, count: np.ndarray, open_: np.ndarray, parents: np.ndarray) -> np.ndarray:
        """The same for nodes 2p and 2p + 1, the children of p: the one of fewer rows (by ``count``) is counted if any of the two
        is ``open_``, the other has the rest of ``parents[p]``."""
        pair = np.arange(len(count)) // 2
        small = np.zeros(len(count), bool)
        small[0::2] = count[0::2] <= count[1::2]
        small[1::2] = ~small[0::2]
        small &= (open_[0::2] | open_[1::2])[pair]
        place = np.cumsum(small) - 1
        live = np.flatnonzero(small.take(of))
        found = self.of(place.take(of.take(live)), int(small.sum()), live if rows is None else rows.take(live))
        out = np.zeros((len(count), *parents.shape[1:]))
        out[small] = found
        rest = np.flatnonzero(~small & small[np.arange(len(count)) ^ 1])
        out[rest] = parents[rest // 2] - out[rest ^ 1]
        return out

    def judged_by(self, best: Best, h: np.ndarray, split: np.ndarray, total: np.ndarray, rule: Rule, paths: np.ndarray, stands: list[np.ndarray]) -> None:
        """Offers the cuts of the nodes to ``split`` from their sums."""
        for f, size in enumerate(self.sizes.tolist()):
            own = h[:, self.offset[f]:self.offset[f + 1]]
            node, b = np.nonzero((own[..., 0] > 0) & split[:, None])
            if len(node):
                judge_sums(best, f, node, np.where(b == size - 1, MISSING, b), own[node, b], total[:, :3], rule, paths, stands[f])

    def goes_right(self, best: Best, of: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        """Where the nodes' cuts send rows; ``of`` is the node of each."""
        n, flat, out = self.bins.shape[1], self.bins.ravel(), np.empty(len(of), bool)
        start, last = best.feature.astype(np.int64) * n, self.sizes[best.feature] - 1
        for at in range(0, len(of), AT_ONCE):
            own = of[at:at + AT_ONCE]
            b = flat.take(start.take(own) + (np.arange(at, at + len(own)) if rows is None else rows[at:at + AT_ONCE]))
            out[at:at + AT_ONCE] = b > best.cut[own]
            if best.missing_left.any():
                out[at:at + AT_ONCE] &= ~((b == last[own]) & best.missing_left[own])
        return out


def grow_counted(counts: Counts, rule: Rule, path, stands: list[np.ndarray]) -> Tree:
    """The tree of all rows, as ``grow_here`` has it, for trees of a bounded number of nodes: every level holds the sums of all
    bins of its nodes. ``counts`` has the rule's statistics, not those of ``gini``."""
    n = counts.bins.shape[1]
    parts = {k: [] for k in ("feature", "cut", "missing_left", "left", "gain", "total")}
    rows, of, depth = None, np.zeros(n, np.int64), 0
    paths, made, h = np.atleast_1d(np.asarray(path, np.uint64)), 1, None
    while len(paths):
        m = len(paths)
        total = counts.totals(of, m, rows)
        split = ~rule.closed(total, depth)
        best = Best(m)
        if split.any():
            h = counts.of(of, 1) if h is None else counts.children(of, rows, total[:, 0], split, h)
            counts.judged_by(best, h, split, total, rule, paths, stands)
        taken = split & enough(best, rule, total)
        place = np.cumsum(taken) - 1
        for k, x in (("feature", np.where(taken, best.feature, -1)), ("cut", best.cut), ("missing_left", best.missing_left),
                     ("left", np.where(taken, made + 2 * place, 0)), ("gain", np.where(taken, best.gain, 0.0)), ("total", total)):
            parts[k].append(x)
        if not taken.any():
            break
        if not taken.all():
            live = np.flatnonzero(taken[of])
            rows, of = live if rows is None else rows[live], of[live]
        of = 2 * place[of] + counts.goes_right(best, of, rows)
        h = h[taken]
        paths = np.stack([child_paths(paths[taken], 0), child_paths(paths[taken], 1)], 1).ravel()
        made += 2 * int(taken.sum())
        depth += 1
    whole = {k: np.concatenate(v) for k, v in parts.items()}
    total = whole.pop("total")
    return Tree(whole["feature"].astype(np.int32), whole["cut"], whole["missing_left"].astype(np.uint8), whole["left"].astype(np.int32), whole["gain"],
                total[:, 0], rule.leaf(total))


def grow_best(counts: Counts, rule: Rule, stands: list[np.ndarray]) -> Tree:
    """The best-first tree of all rows: ``rule.splits`` times the leaf whose cut has the greatest gain is split (ties to the upper
    one, then to the left). Nothing is counted for a leaf that growth does not come to."""
    n = counts.bins.shape[1]
    parts = {k: [] for k in ("feature", "cut", "missing_left", "left", "gain", "total")}
    queue: list = []

    def add(own: list, h: np.ndarray | None, total: np.ndarray, depth: int, places: list[int]):
        """Nodes of one depth with their rows, sums and places in it."""
        best, split = Best(len(own)), ~rule.closed(total, depth)
        if h is not None:
            counts.judged_by(best, h, split, total, rule, np.zeros(len(own), np.uint64), stands)
        for k, ok in enumerate(split & enough(best, rule, total)):
            at = len(parts["total"])
            for name, x in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", 0), ("gain", 0.0), ("total", total[k])):
                parts[name].append(x)
            if ok:
                heapq.heappush(queue, (-best.gain[k], depth, places[k], at, own[k], h[k], best.feature[k], best.cut[k], best.missing_left[k]))
    add([None], counts.of(np.zeros(n, np.int64), 1), counts.totals(np.zeros(n, np.int64), 1), 0, [0])
    for left in range(rule.splits, 0, -1):
        if not queue:
            break
        gain, depth, place, at, rows, h, f, cut, side = heapq.heappop(queue)
        best = Best(1)
        best.feature[0], best.cut[0], best.missing_left[0] = f, cut, side
        right = counts.goes_right(best, np.zeros(n if rows is None else len(rows), np.int64), rows)
        own = [np.flatnonzero(~right), np.flatnonzero(right)]
        own = own if rows is None else [rows.take(x) for x in own]
        total = np.concatenate([counts.totals(np.zeros(len(r), np.int64), 1, r) for r in own])
        for name, x in (("feature", f), ("cut", cut), ("missing_left", side), ("left", len(parts["total"])), ("gain", -gain)):
            parts[name][at] = x
        found = None
        if left > 1 and not rule.closed(total, depth + 1).all():
            small = int(len(own[1]) < len(own[0]))
            part = counts.of(np.zeros(len(own[small]), np.int64), 1, own[small])[0]
            found = np.stack([h - part, part] if small else [part, h - part])
        add(own, found, total, depth + 1, [2 * place, 2 * place + 1])
    total = np.array(parts["total"])
    return Tree(np.array(parts["feature"], np.int32), np.array(parts["cut"], np.uint8), np.array(parts["missing_left"], np.uint8),
                np.array(parts["left"], np.int32), np.array(parts["gain"], float), total[:, 0], rule.leaf(total))


# ------------------------------------------------------------------ passes over the blocks
class Source:
    """What the members see of a block. ``stats`` gives the rows that a member has and what is sent of them:
    [rows, G, H, (extra)], or [rows, weight, class]."""

    def of(self, block):
        return block

    def stats(self, seen, member):
        raise NotImplementedError


def _layout(binned: Binned) -> np.ndarray:
    """Where each feature's bins begin in a histogram; every feature has a bin for missing values."""
    return np.concatenate(([0], np.cumsum([len(c) + 2 for c in binned.cuts])))


HISTOGRAMS = "member int, node int, features binary, path bigint, wide boolean, hist binary"


def _histograms(cuts: list, members: list, tops: list[Tree], open_: list[dict], paths: list[dict], wide: set, source: Source, rule: Rule):
    """Blocks -> histograms of the open nodes: ``open_[m][node]`` is the list of its features."""
    d, sizes = len(cuts), np.array([len(c) + 2 for c in cuts])

    def work(batches):
        blocks = [source.of(b) for b in blocks_in(batches, d)]
        at, width = 0, rule.width
        while at < len(members):
            held, some = {}, []
            while at < len(members) and (not some or sum(held.values()) < HELD):
                held[at] = sum(int(sizes[f].sum()) for f in open_[at].values()) * width * 8
                some.append(at)
                at += 1
            sums = {m: {node: np.zeros((int(sizes[f].sum()), width)) for node, f in open_[m].items()} for m in some}
            for seen in blocks:
                for m in some:
                    if open_[m]:
                        _add(sums[m], seen, m)
            rows = [(m, node, open_[m][node].tobytes(), paths[m][node], (m, node) in wide, h.tobytes()) for m in some for node, h in sums[m].items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()))], names=[x.split()[0] for x in HISTOGRAMS.split(", ")])

    def _add(sums, seen, m):
        rows, sent = source.stats(seen, members[m])
        if not len(rows):
            return
        bins = seen.bins[:, rows] if len(rows) < seen.n else seen.bins
        leaf = tops[m].leaves(bins)
        nodes = list(open_[m])
        place = np.full(len(tops[m].feature), -1)
        place[nodes] = np.arange(len(nodes))
        of = place[leaf]
        s = rule.expand(sent)
        plans = {}
        for k, node in enumerate(nodes):                       # nodes that try the same features are counted together
            plans.setdefault(tuple(open_[m][node].tolist()), []).append(k)
        for features, which in plans.items():
            own = np.flatnonzero(np.isin(of, which)) if len(plans) > 1 else np.flatnonzero(of >= 0)
            if not len(own):
                continue
            offset, local = 0, np.full(len(nodes), -1)
            local[which] = np.arange(len(which))
            base, own_s = local[of[own]], s[own]
            for f in features:
                size = int(sizes[f])
                b = bins[f, own]
                code = base * size + np.where(b == MISSING, size - 1, b)
                for c in range(rule.width):
                    h = np.bincount(code, weights=own_s[:, c], minlength=size * len(which)).reshape(len(which), size)
                    for j, k in enumerate(which):
                        sums[nodes[k]][offset:offset + size, c] += h[j]
                offset += size
    return work


def _choose(cuts: list, stands: list, rule: Rule):
    """Histograms of one (member, node) -> its total and its best cut, with the totals of the children."""
    sizes = np.array([len(c) + 2 for c in cuts])

    def work(key, parts):
        features = np.frombuffer(parts["features"].iloc[0], np.int32)
        path = np.array([parts["path"].iloc[0]], np.int64).view(np.uint64)
        size = sizes[features]
        h = sum(np.frombuffer(x).reshape(int(size.sum()), rule.width) for x in sorted(parts["hist"]))
        total = h[:size[0]].sum(0)[None, :] if len(size) else np.zeros((1, rule.width))
        best, at, sums = Best(1), 0, {}
        for f, n in zip(features.tolist(), size.tolist()):
            own = h[at:at + n]
            at += n
            bins = np.append(np.arange(n - 1), MISSING)
            some = own[:, 0] > 0
            sums[f] = own
            judge(best, f, np.zeros(int(some.sum()), np.int64), bins[some], own[some], total, rule, path, stands[f])
            if best.feature[0] >= 0 and parts["wide"].iloc[0]:
                break
        f, left = int(best.feature[0]), np.zeros(rule.width)
        if f >= 0:
            own = sums[f]
            left = own[:int(best.cut[0]) + 1].sum(0) + (own[-1] if best.missing_left[0] else 0)
        return pd.DataFrame({"member": [key[0]], "node": [key[1]], "gain": [float(best.gain[0])], "feature": [f], "cut": [int(best.cut[0])],
                             "missing_left": [bool(best.missing_left[0])], "total": [total.tobytes()], "left": [left.tobytes()]})
    return work


ROWS = "member int, node int, depth int, path bigint, n int, bins binary, sent binary"


def _rows_of(cuts: list, members: list, tops: list[Tree], local: list[np.ndarray], places: list[dict], source: Source, rows_at_once: int):
    """Blocks -> the rows of the nodes that one task finishes; ``places[m][node]`` is the node's depth and path."""
    d = len(cuts)

    def work(batches):
        for b in blocks_in(batches, d):
            seen = source.of(b)
            out = []
            for m, member in enumerate(members):
                if not len(local[m]):
                    continue
                rows, sent = source.stats(seen, member)
                bins = seen.bins[:, rows]
                leaf = tops[m].leaves(bins)
                order = np.argsort(leaf, kind="stable")
                bounds = np.searchsorted(leaf[order], np.stack([local[m], local[m] + 1], 1))
                for node, (a, z) in zip(local[m].tolist(), bounds.tolist()):
                    if z > a:
                        own = order[a:z]
                        out.append((m, node, *places[m][node], z - a, np.ascontiguousarray(bins[:, own]).tobytes(), np.ascontiguousarray(sent[own]).tobytes()))
            for at in range(0, len(out), rows_at_once):
                part = out[at:at + rows_at_once]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(
                    (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in ROWS.split(", ")])
    return work


def _finish(cuts: list, stands: list, rule: Rule, width: int):
    """All rows of one (member, node) -> its tree."""
    d = len(cuts)

    def work(key, parts):
        parts = parts.sort_values(["n", "bins", "sent"])              # one order, whatever the layout
        bins = np.concatenate([np.frombuffer(x, np.uint8).reshape(d, n) for x, n in zip(parts["bins"], parts["n"])], axis=1)
        sent = np.concatenate([np.frombuffer(x).reshape(n, width) for x, n in zip(parts["sent"], parts["n"])])
        path = np.array([parts["path"].iloc[0]], np.int64).view(np.uint64)
        tree = grow_here(bins, rule.expand(sent), rule, int(parts["depth"].iloc[0]), path, stands)
        return pd.DataFrame({"member": [key[0]], "node": [key[1]], "tree": [tree.packed(rule.min_gain is not None)]})
    return work


@dataclass
class Grown:
    """Members' trees: the levels that were grown together, and a table ``member, node, tree`` of what is below some of their leaves."""
    tops: list
    below: DataFrame | list | None                  # a written table, or its rows where the caller wants them all
    nodes: list = field(default_factory=list)       # for each member the leaves that go on


def rows_of_a_task(binned: Binned) -> int:
    """Rows of a node that one task finishes."""
    return max(LOCAL, min(MOST_LOCAL, binned.n_rows // NODES))


def grow(binned: Binned, members: list, trees: list[int], source: Source, rule: Rule, seed: int = 42, local: int | None = None,
         chosen=None, blocks: DataFrame | None = None, collect: bool = False) -> Grown:
    """Trees of all ``members``; ``trees`` are the numbers that their random draws follow.

    ``collect`` is for trees of a bounded size. ``chosen(growing trees)`` may name the nodes of each member that are worth splitting (best-first growth)."""
    local = rows_of_a_task(binned) if local is None else local
    d, blocks = len(binned.features), binned.blocks if blocks is None else blocks
    own = [Growing(rule) for _ in members]
    state = []                                       # (member, node) -> features to try
    for g, t in zip(own, trees):
        g.add(0, root_path(t, seed), np.zeros(rule.width))
        path = g.path[0]
        first = rule.first_features(path, d)[0]
        state.append({0: np.sort(first[:rule.max_features or d]).astype(np.int32)} if d else {})
    here: list[dict] = [{} for _ in members]
    if binned.n_rows <= local:                       # one task finishes the whole tree of a member
        here, state = [{0: True} for _ in members], [{} for _ in members]
    wide = set()
    first_level = True
    while any(state):
        tops = [g.tree() for g in own]
        paths = [{n: signed(own[m].path[n]) for n in s} for m, s in enumerate(state)]
        found = blocks.mapInArrow(_histograms(binned.cuts, members, tops, state, paths, wide, source, rule), HISTOGRAMS) \
            .groupBy("member", "node").applyInPandas(
                _choose(binned.cuts, binned.stands, rule),
                "member int, node int, gain double, feature int, cut int, missing_left boolean, total binary, left binary").collect()
        state = [{} for _ in members]
        opened = []
        for r in sorted(found, key=lambda r: (r.member, r.node)):
            g, total, left = own[r.member], np.frombuffer(r.total), np.frombuffer(r.left)
            if first_level:
                g.total[r.node] = total
            if bool(rule.closed(g.total[r.node], g.depth[r.node])[0]):
                continue
            if r.feature < 0:
                if rule.max_features is not None and (r.member, r.node) not in wide and rule.max_features < d:
                    # none of its first features can be cut: all in their order, the first that can be cut decides
                    wide.add((r.member, r.node))
                    state[r.member][r.node] = rule.first_features(g.path[r.node], d)[0].astype(np.int32)
                continue
            if rule.min_gain is not None and not r.gain > rule.min_gain:
                continue
            opened += [(r.member, k) for k in g.split(r.node, r.gain, r.feature, r.cut, r.missing_left, left, total - left)]
        worth = chosen([g.tree() for g in own]) if chosen else None
        for m, n in opened:
            g = own[m]
            if bool(rule.closed(g.total[n], g.depth[n])[0]) or (worth is not None and n not in worth[m]):
                continue
            if g.total[n][0] <= local:
                here[m][n] = True
            else:
                first = rule.first_features(g.path[n], d)[0]
                state[m][n] = np.sort(first[:rule.max_features or d]).astype(np.int32)
        first_level = False
    tops, below = [g.tree() for g in own], None
    nodes = [np.array(sorted(h), np.int64) for h in here]
    if any(len(n) for n in nodes):
        places = [{n: (own[m].depth[n], signed(own[m].path[n])) for n in ns.tolist()} for m, ns in enumerate(nodes)]
        width = 3 + (rule.extra if rule.kind != "gini" else 0)
        below = blocks.mapInArrow(_rows_of(binned.cuts, members, tops, nodes, places, source, 256), ROWS).groupBy("member", "node").applyInPandas(
                _finish(binned.cuts, binned.stands, rule, width), "member int, node int, tree binary")
        below = below.collect() if collect else written(below, "trees")
    return Grown(tops, below, nodes)


def joined(grown: Grown) -> list[Tree]:
    """Whole trees on the driver; the caller has checked their size."""
    below = {} if grown.below is None else {(r.member, r.node): Tree.unpacked(r.tree) for r in (grown.below if isinstance(grown.below, list) else grown.below.collect())}
    out = []
    for m, top in enumerate(grown.tops):
        parts = {k: [getattr(top, k).copy()] for k in ("feature", "cut", "missing_left", "left", "gain", "rows", "value")}
        size = len(top.feature)
        for n in (grown.nodes[m].tolist() if grown.nodes else []):
            t = below[m, n]
            # the first node of the lower tree takes the leaf's place, the others follow
            for k in ("feature", "cut", "missing_left", "gain", "rows", "value"):
                parts[k][0][n] = getattr(t, k)[0]
                parts[k].append(getattr(t, k)[1:])
            parts["left"][0][n] = t.left[0] + size - 1
            parts["left"].append(t.left[1:] + size - 1)
            size += len(t.feature) - 1
        out.append(Tree(*(np.concatenate(parts[k]) for k in ("feature", "cut", "missing_left", "left", "gain", "rows", "value"))))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
