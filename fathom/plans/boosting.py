"""Gradient boosting over the shared binned table.

A round grows the trees of all classes and folds in the same passes over the
blocks (``trees.grow``), from the gradients and Hessians of the joint loss:
squared error, logistic loss for two classes, softmax for more. Scores so far
are kept with the blocks and written anew every ``KEEP`` rounds; between
writes the passes add the last trees themselves. Where a member's rows fit in
a task, a few tasks read all blocks and grow their members' trees whole:
nothing is shuffled, and a level needs no pass of its own.

Four learners differ in how trees grow and leaves are valued:

* ``gbm``: cuts by the variance of the gradients, depth 3, leaves by one Newton
  step for the log losses.
* ``xgb``: second-order gain with penalty 1 on leaves, depth 6, a learned side
  for missing values, children of at least Hessian 1.
* ``lgbm``: second-order gain without penalty, leaves of at least 20 rows, the
  best leaf first, up to 31 leaves, no bound on depth.
* ``catboost``: symmetric trees of depth 6, one cut for all nodes of a level
  by the summed second-order gain with penalty 3.
"""

from __future__ import annotations

import heapq
import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fathom.plans import trees as T
from fathom.plans.binned import BLOCKS, MISSING, Binned, bin_matrix, blocks_in, feature, prepare
from fathom.plans.forest import class_of
from fathom.plans.trees import NEAR, Counts, Tree, grow_best, grow_counted, grow_here, root_path   # by name: tasks get them by value
from fathom.session import written

#: Rounds between two writes of the scores, and rows that one task finishes of a round's tree.
KEEP, LOCAL = 8, 1 << 16
#: Tasks at most among which the members of a round are dealt; each of them may hold ``LOCAL`` rows for every such task.
SHARED = 16
#: A task grows all rounds of a fit of one output from ``LOCAL`` cells times ``SHARED`` and bins of ``LOCAL`` times this, at most.
BINS_OF_A_FIT = 1 << 7
#: Depth, or leaves, of a tree whose nodes' histograms are held together at most; rows from which on a leaf is counted by itself.
DEPTH, LEAVES, MANY = 8, 256, 1 << 14


@dataclass
class Booster:
    """Parameters of a learner, under the libraries' common names."""
    kind: str
    rounds: int = 100
    rate: float = 0.1
    depth: int | None = 3
    leaves: int | None = None
    penalty: float = 0.0
    min_rows: int = 1
    min_weight: float = 0.0
    min_gain: float | None = None
    min_split: int = 2
    symmetric: bool = False


def booster_for(name: str, params: dict) -> Booster:
    """The learner of a model name with its library's defaults, changed by ``params``."""
    kind = {"Gradi": "gbm", "XGB": "xgb", "LGBM": "lgbm", "CatBo": "catboost"}[next(k for k in ("Gradi", "XGB", "LGBM", "CatBo") if name.startswith(k))]
    # The libraries' defaults.
    out = {"gbm": Booster("gbm", 100, 0.1, 3),
           "xgb": Booster("xgb", 100, 0.3, 6, penalty=1.0, min_weight=1.0, min_gain=1e-6),
           "lgbm": Booster("lgbm", 100, 0.1, None, 31, min_rows=20, min_weight=1e-3, min_gain=0.0),
           "catboost": Booster("catboost", 1000, 0.03, 6, penalty=3.0, symmetric=True)}[kind]
    names = {"n_estimators": ("rounds", int), "iterations": ("rounds", int), "learning_rate": ("rate", float), "max_depth": ("depth", int),
             "depth": ("depth", int), "num_leaves": ("leaves", int), "reg_lambda": ("penalty", float), "l2_leaf_reg": ("penalty", float),
             "min_child_samples": ("min_rows", int), "min_child_weight": ("min_weight", float), "min_samples_split": ("min_split", int)}
    for k, v in params.items():
        if k in names and v is not None and not (k == "max_depth" and kind == "lgbm" and int(v) <= 0):
            to, kind_of = names[k]
            setattr(out, to, kind_of(v))
    return out


def rule_of(b: Booster, classes: int) -> T.Rule:
    return T.Rule("newton", penalty=b.penalty, extra=b.kind == "gbm" and classes > 0, max_depth=b.depth, min_split=b.min_split, min_rows=b.min_rows,
                  min_weight=b.min_weight, min_gain=b.min_gain, splits=b.leaves - 1 if b.leaves else None, spread=b.min_gain is None and not b.symmetric)


# ------------------------------------------------------------------ losses
def first_scores(kind: str, shares: np.ndarray, mean: float) -> np.ndarray:
    """The score of each class (or of the one regression target) before the first round."""
    if not len(shares):
        return np.array([mean])
    with np.errstate(divide="ignore"):
        if len(shares) == 2:
            odds = np.log(shares[1]) - np.log(shares[0])
            return np.array([0.0 if kind == "catboost" else odds])
        return np.zeros(len(shares)) if kind in ("xgb", "catboost") else np.log(np.maximum(shares, np.finfo(np.float32).eps))


def shares_of(score: np.ndarray) -> np.ndarray:
    """Class shares (classes, n) of scores (1 or classes, n)."""
    if len(score) == 1:
        p = 1.0 / (1.0 + np.exp(-score[0]))
        return np.stack([1 - p, p])
    e = np.exp(score - score.max(0))
    return e / e.sum(0)


def gradients(kind: str, score: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradient and Hessian (members, n) of one fit's scores."""
    if not classes:
        return y - score, np.ones_like(score)
    p = shares_of(score)
    if classes == 2:
        return (y == 1)[None, :] - p[1:], p[1:] * (1 - p[1:])
    g = (np.arange(classes)[:, None] == y) - p
    if kind == "gbm":
        return g, np.abs(g) * (1 - np.abs(g)) * classes / (classes - 1)     # one leaf's Newton step is its sum of g over this
    factor = {"xgb": 2.0, "lgbm": classes / (classes - 1)}.get(kind, 1.0)
    return g, np.maximum(factor * p * (1 - p), 1e-16)


@dataclass
class _Seen:
    n: int
    bins: np.ndarray
    c: np.ndarray
    fold: np.ndarray
    g: np.ndarray
    h: np.ndarray


class Rounds(T.Source):
    """Members ``(fit, class)`` over blocks with scores; fit f leaves out the rows of fold ``folds[f]``."""

    def __init__(self, kind: str, rate: float, classes: int, folds: list[int], start: np.ndarray, pending: list, extra: bool):
        self.kind, self.rate, self.classes, self.folds, self.start, self.pending, self.extra = kind, rate, classes, folds, start, pending, extra

    def scores(self, block) -> np.ndarray:
        """(fits, outputs, n)."""
        k = self.start.shape[1]
        if block.f is None:
            f = np.repeat(self.start[:, :, None], block.n, axis=2)
        else:
            f = np.frombuffer(block.f).reshape(len(self.folds), k, block.n).copy()
        for trees in self.pending:
            for m, t in enumerate(trees):
                f[m // k, m % k] += self.rate * t.value[t.leaves(block.bins), 0]
        return f

    def of(self, block):
        both = [gradients(self.kind, f, block.y, self.classes) for f in self.scores(block)]
        return _Seen(block.n, block.bins, block.c, block.fold, np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both]))

    def stats(self, seen, member):
        fit, output = member
        fold, m = self.folds[fit], fit * self.start.shape[1] + output
        rows = np.flatnonzero(seen.fold != fold) if fold >= 0 else np.arange(seen.n)
        c = seen.c[rows].astype(float)
        g, h = c * seen.g[m, rows], c * seen.h[m, rows]
        return rows, np.column_stack([c, g, c, h] if self.extra else [c, g, h])


def _with_scores(d: int, source: Rounds):
    """Blocks with their scores as of now."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def work(batches):
        for b in batches:
            for i, block in enumerate(blocks_in([b], d)):
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in names), pa.array([source.scores(block).tobytes()], pa.binary())], names=[*names, "f"])
    return work


# ------------------------------------------------------------------ best-first trees
def best_first(tree: Tree, leaves: int) -> tuple[Tree, set]:
    """``tree`` cut to its ``leaves - 1`` best splits, each the best of those whose parent is split, and the
    nodes of ``tree`` that are children of these."""
    chosen, queue, last = [], [], set()
    if tree.feature[0] >= 0:
        heapq.heappush(queue, (-tree.gain[0], 0))
    while queue and len(chosen) < leaves - 1:
        _, n = heapq.heappop(queue)
        chosen.append(n)
        for kid in (int(tree.left[n]), int(tree.left[n]) + 1):
            last.add(kid)
            if tree.feature[kid] >= 0:
                heapq.heappush(queue, (-tree.gain[kid], kid))
    inner = set(chosen)
    number, order = {0: 0}, [0]
    for n in order:
        if n in inner:
            for kid in (int(tree.left[n]), int(tree.left[n]) + 1):
                number[kid] = len(order)
                order.append(kid)
    at = np.array(order)
    is_inner = np.array([n in inner for n in order])
    left = np.array([number[int(tree.left[n])] if n in inner else 0 for n in order], np.int32)
    return Tree(np.where(is_inner, tree.feature[at], -1).astype(np.int32), tree.cut[at], tree.missing_left[at], left, np.where(is_inner, tree.gain[at], 0.0),
                tree.rows[at], tree.value[at]), last


# ------------------------------------------------------------------ symmetric trees
def _symmetric_level(cuts: list, stands: list, rule: T.Rule, level: int):
    """Histograms of all nodes of a member's level -> the one cut with the greatest summed gain, and the nodes' children."""
    sizes = np.array([len(c) + 2 for c in cuts])

    def work(key, parts):
        h = np.zeros((1 << level, int(sizes.sum()), rule.width))
        for node, data in sorted(zip(parts["node"], parts["hist"])):
            h[node] += np.frombuffer(data).reshape(-1, rule.width)
        f, cut, side, left = symmetric_cut(h, sizes, rule)
        return pd.DataFrame({"member": [key[0]], "feature": [f], "cut": [cut], "missing_left": [side], "total": [h[:, :sizes[0]].sum(1).tobytes()],
                             "left": [left.tobytes()]})
    return work


def symmetric_cut(h: np.ndarray, sizes: np.ndarray, rule: T.Rule):
    """(feature, cut, missing left, left totals) with the greatest gain summed over nodes; feature -1 if none has any. h: (nodes, bins, statistics)."""
    best, at = (0.0, -1, 0, False, np.zeros((len(h), rule.width))), 0
    for f, n in enumerate(sizes.tolist()):
        own = h[:, at:at + n]
        at += n
        total = own.sum(1)
        parent = rule.score(total)
        upto, missing = np.cumsum(own[:, :-1], axis=1)[:, :-1], own[:, -1:]
        for side in (False, True) if missing[..., 0].any() else (False,):
            left = upto + missing if side else upto
            gain = (rule.score(left) + rule.score(total[:, None] - left) - parent[:, None]).sum(0)
            if len(gain):
                top = gain.max()
                if top > best[0] + NEAR * max(float(np.abs(parent).sum()), abs(top)):
                    b = int(np.flatnonzero(gain >= top - NEAR * max(float(np.abs(parent).sum()), abs(top)))[0])
                    best = (float(gain[b]), f, b, side, left[:, b])
    return best[1:]


def _symmetric_tree(levels: list, totals: np.ndarray, rule: T.Rule) -> Tree:
    """A full tree whose levels have one cut each; ``totals`` are those of the last level's nodes."""
    depth = len(levels)
    inner = (1 << depth) - 1
    feature = np.full(inner + (1 << depth), -1, np.int32)
    cut, side = np.zeros(len(feature), np.uint8), np.zeros(len(feature), np.uint8)
    for k, (f, c, s) in enumerate(levels):
        own = slice((1 << k) - 1, (2 << k) - 1)
        feature[own], cut[own], side[own] = f, c, s
    left = np.where(feature >= 0, 2 * np.arange(len(feature)) + 1, 0).astype(np.int32)
    value = np.zeros((len(feature), 1))
    value[inner:] = rule.leaf(totals)
    rows = np.zeros(len(feature))
    rows[inner:] = totals[:, 0]
    return Tree(feature, cut, side, left, np.zeros(len(feature)), rows, value)


def symmetric_here(counts: T.Counts, rule: T.Rule, depth: int) -> Tree:
    """The symmetric tree of all rows."""
    node = np.zeros(counts.bins.shape[1], np.int64)
    levels, totals, h = [], counts.totals(node, 1), None
    for level in range(depth):
        h = counts.of(node, 1) if h is None else counts.children(node, None, totals[:, 0], np.ones(1 << level, bool), h)
        f, cut, side, left = symmetric_cut(h, counts.sizes, rule)
        if f < 0:
            break
        levels.append((f, cut, side))
        totals = np.stack([left, totals - left], 1).reshape(2 << level, -1)
        b = counts.bins[f]
        right = (b > cut) & (b != counts.sizes[f] - 1) if side else b > cut
        node = 2 * node + right
    return _symmetric_tree(levels, totals, rule)


def grow_symmetric(binned: Binned, blocks: DataFrame, members: list, source: T.Source, rule: T.Rule, depth: int) -> list[Tree]:
    d, n = len(binned.features), len(members)
    levels, totals = [[] for _ in members], [None] * n
    every = np.arange(d, dtype=np.int32)
    for level in range(depth):
        tops = [_numbered(lv, rule) for lv in levels]
        open_ = [{(1 << level) - 1 + k: every for k in range(1 << level)} if len(lv) == level else {} for lv in levels]
        if not any(open_):
            break
        nodes = [{k: 0 for k in o} for o in open_]
        found = blocks.mapInArrow(T._histograms(binned.cuts, members, tops, open_, nodes, set(), source, rule), T.HISTOGRAMS) \
            .withColumn("node", F.col("node") - ((1 << level) - 1)).groupBy("member").applyInPandas(
                _symmetric_level(binned.cuts, binned.stands, rule, level), "member int, feature int, cut int, missing_left boolean, total binary, left binary").collect()
        for r in found:
            total, left = (np.frombuffer(x).reshape(1 << level, -1) for x in (r.total, r.left))
            totals[r.member] = total if totals[r.member] is None else totals[r.member]
            if r.feature >= 0:
                levels[r.member].append((r.feature, r.cut, r.missing_left))
                totals[r.member] = np.stack([left, total - left], 1).reshape(2 << level, -1)
    return [_symmetric_tree(lv, t, rule) for lv, t in zip(levels, totals)]


def _numbered(levels: list, rule: T.Rule) -> Tree:
    return _symmetric_tree(levels, np.zeros((1 << len(levels), rule.width)), rule)


# ------------------------------------------------------------------ whole trees, and whole fits, in a task
def tree_here(bins: np.ndarray, sent: list, sizes: np.ndarray, rule: T.Rule, turn: int, stands: list, symmetric: int | None) -> Tree:
    """A round's tree of one member from all of its rows: ``bins`` (features, rows) and the statistics that are sent of them."""
    best = rule.splits is not None and rule.splits < LEAVES and bins.shape[1] >= MANY
    few = symmetric is not None or best or (rule.splits is None and rule.max_depth is not None and rule.max_depth <= DEPTH)
    s = sent if few and not rule.spread else rule.expand(np.column_stack(sent))
    if not few:
        return grow_here(bins, s, rule, 0, root_path(turn, 42), stands)
    counts = Counts(bins, sizes, list(s.T) if rule.spread else s)
    if symmetric is not None:
        return symmetric_here(counts, rule, symmetric)
    return grow_best(counts, rule, stands) if best else grow_counted(counts, rule, root_path(turn, 42), stands)


def _whole(binned_cuts: list, stands: list, own: list, source: Rounds, rule: T.Rule, turn: int, symmetric: int | None):
    """All blocks -> the trees of the members ``own`` (number, member)."""
    d, sizes = len(binned_cuts), np.array([len(c) + 2 for c in binned_cuts])

    def work(batches):
        held = []
        for block in blocks_in(batches, d):
            seen = source.of(block)
            held.append((block.block, block.bins, [source.stats(seen, member) for _, member in own]))
        held.sort(key=lambda x: x[0])                                        # one order, whatever the layout
        whole = np.concatenate([bins for _, bins, _ in held], axis=1) if held else np.zeros((d, 0), np.uint8)
        starts = np.cumsum([0] + [bins.shape[1] for _, bins, _ in held])
        out = []
        for k, (m, _) in enumerate(own):
            rows = np.concatenate([a + parts[k][0] for a, (_, _, parts) in zip(starts, held)]) if held else np.zeros(0, np.int64)
            if not len(rows):
                continue
            sent = list(np.concatenate([parts[k][1] for _, _, parts in held]).T)
            bins = whole if len(rows) == whole.shape[1] else whole[:, rows]
            out.append((m, tree_here(bins, sent, sizes, rule, turn, stands, symmetric).packed()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["member", "tree"])
    return work


def _fit(binned_cuts: list, stands: list, booster: Booster, rule: T.Rule, classes: int, start: float, fold: int):
    """All blocks -> the trees of all rounds of a fit of one output, which leaves out ``fold``."""
    d, sizes = len(binned_cuts), np.array([len(c) + 2 for c in binned_cuts])

    def work(batches):
        held = sorted(((b.block, np.flatnonzero(b.fold != fold), b) for b in blocks_in(batches, d)), key=lambda x: x[0])     # one order, whatever the layout
        bins, y, c = (np.concatenate([x[..., rows] for x, rows in parts], axis=-1) if held else np.zeros((d, 0), np.uint8)
                      for parts in ([(getattr(b, name), rows) for _, rows, b in held] for name in ("bins", "y", "c")))
        held.clear()
        f, n = np.full((1, bins.shape[1]), start), c.astype(float)
        for turn in range(booster.rounds if bins.shape[1] else 0):
            g, h = gradients(booster.kind, f, y, classes)
            h = n * h[0] if classes else n
            tree = tree_here(bins, [n, n * g[0], n, h] if rule.extra else [n, n * g[0], h], sizes, rule, turn, stands, booster.depth if booster.symmetric else None)
            tree = best_first(tree, booster.leaves)[0] if booster.leaves else tree
            if len(tree.feature) == 1 and tree.value[0, 0] == 0:
                break                                           # nothing is left to learn
            f[0] += booster.rate * tree.value[tree.leaves(bins), 0]
            yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([tree.packed()], pa.binary())], names=["turn", "tree"])
        if bins.shape[1]:                                       # the fit's end, which a fit without rows does not have
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary())], names=["turn", "tree"])
    return work


def fit_whole(binned: Binned, booster: Booster, rule: T.Rule, classes: int, folds: list[int], start: np.ndarray) -> list[list[Tree]] | None:
    """The trees of all rounds of fits of one output, each fit in a task that reads all blocks once; None if a fit has no rows."""
    blocks = binned.blocks.coalesce(1)
    parts = [blocks.mapInArrow(_fit(binned.cuts, binned.stands, booster, rule, classes, float(start[i, 0]), fold), "turn int, tree binary") for i, fold in enumerate(folds)]
    with ThreadPoolExecutor(min(SHARED, len(parts))) as pool:
        found = [{r.turn: r.tree for r in rows} for rows in pool.map(DataFrame.collect, parts)]
    if not all(-1 in f for f in found):
        return None
    done = Tree(np.full(1, -1, np.int32), *(np.zeros(1, k) for k in (np.uint8, np.uint8, np.int32, float, float)), np.zeros((1, 1)))
    return [[Tree.unpacked(f[turn]) if turn in f else done for f in found] for turn in range(max(len(f) - 1 for f in found))]


def grow_whole(binned: Binned, blocks: DataFrame, members: list, source: Rounds, rule: T.Rule, turn: int, symmetric: int | None) -> list[Tree] | None:
    """The trees of all members, each grown in one of at most ``SHARED`` tasks that read all blocks; None if a member has no rows."""
    numbered, deals = list(enumerate(members)), min(SHARED, len(members))
    parts = [blocks.coalesce(1).mapInArrow(_whole(binned.cuts, binned.stands, numbered[k::deals], source, rule, turn, symmetric), "member int, tree binary")
             for k in range(deals)]
    # a job of one task for each: the table is scanned by all of them and not exchanged (a union of single partitions would be one task)
    with ThreadPoolExecutor(deals) as pool:
        found = {r.member: r.tree for rows in pool.map(DataFrame.collect, parts) for r in rows}
    return [Tree.unpacked(found[m]) for m in range(len(members))] if len(found) == len(members) else None


# ------------------------------------------------------------------ rounds
@dataclass
class Boosted:
    """``trees[round][member]``; members are (fit, output) in order."""
    binned: Binned
    booster: Booster
    start: np.ndarray           # (fits, outputs)
    folds: list
    trees: list = field(default_factory=list)
    blocks: DataFrame | None = None

    @property
    def classes(self) -> int:
        return len(self.binned.classes) if self.binned.classes is not None else 0


def class_shares(binned: Binned, folds: list[int], classes: int) -> np.ndarray:
    """(fits, classes): shares among the rows outside each fold; and the target's mean there for regression."""
    d = len(binned.features)

    def work(batches):
        for b in blocks_in(batches, d):
            for fold in np.unique(b.fold).tolist():
                own = b.fold == fold
                if classes:
                    n = np.bincount(b.y[own].astype(int), weights=b.c[own], minlength=classes)
                    yield pd_batch([(fold, k, n[k], 0.0) for k in range(classes)])
                else:
                    yield pd_batch([(fold, 0, float(b.c[own].sum()), float((b.c[own] * (b.y[own] - binned_mean)).sum()))])

    def pd_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64()))],
                                          names=["fold", "k", "n", "s"])
    binned_mean = binned.mean
    found = binned.blocks.mapInArrow(work, "fold int, k int, n double, s double").groupBy("fold", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = np.zeros((len(folds), max(1, classes)))
    for i, fold in enumerate(folds):
        own = [r for r in found if r.fold != fold]
        if classes:
            for r in own:
                out[i, r.k] += r.n
            out[i] /= max(1.0, out[i].sum())
        else:
            n = sum(r.n for r in own)
            out[i, 0] = binned.mean + (sum(r.s for r in own) / n if n else 0.0)
    return out


def boost(binned: Binned, booster: Booster, folds: list[int] = (-1,), local: int | None = None) -> Boosted:
    """All rounds of one fit for each entry of ``folds`` (the fold that it leaves out, -1: none)."""
    folds, local, d = list(folds), LOCAL if local is None else local, len(binned.features)
    classes = len(binned.classes) if binned.classes is not None else 0
    of = class_shares(binned, folds, classes)
    start = np.stack([first_scores(booster.kind, s if classes else np.zeros(0), s[0]) for s in of])
    out = Boosted(binned, booster, start, folds, [], binned.blocks)
    rule, outputs = rule_of(booster, classes), start.shape[1]
    members = [(f, k) for f in range(len(folds)) for k in range(outputs)]
    cells = int(binned.blocks.agg(F.sum("n").alias("n")).first().n or 0)
    if outputs == 1 and cells <= local * SHARED and cells * d <= local * BINS_OF_A_FIT:
        whole = fit_whole(binned, booster, rule, classes, folds, start)
        if whole is not None:
            out.trees = whole
            return out
    here = cells <= local * min(SHARED, len(members))
    pending: list = []
    for turn in range(booster.rounds):
        source = Rounds(booster.kind, booster.rate, classes, folds, start, pending, rule.extra)
        if len(pending) >= KEEP:
            out.blocks = written(out.blocks.select(*[x.split()[0] for x in BLOCKS.split(", ")], *(["f"] if "f" in out.blocks.columns else []))
                                 .mapInArrow(_with_scores(d, source), f"{BLOCKS}, f binary"), "boosted")
            pending = []
            source = Rounds(booster.kind, booster.rate, classes, folds, start, pending, rule.extra)
        trees = grow_whole(binned, out.blocks, members, source, rule, turn, booster.depth if booster.symmetric else None) if here else None
        if booster.symmetric:
            trees = trees or grow_symmetric(binned, out.blocks, members, source, rule, booster.depth)
        elif trees is None:
            worth = (lambda ts: [best_first(t, booster.leaves)[1] for t in ts]) if booster.leaves else None
            trees = T.joined(T.grow(binned, members, [turn] * len(members), source, rule, local=local, chosen=worth, blocks=out.blocks, collect=True))
        if booster.leaves:
            trees = [best_first(t, booster.leaves)[0] for t in trees]
        if all(len(t.feature) == 1 and t.value[0, 0] == 0 for t in trees):
            break                                           # nothing is left to learn
        out.trees.append(trees)
        pending = [*pending, trees]
    return out


@dataclass
class BoostedFitted:
    name: str
    task: str
    model: Boosted
    note: str | None = None

    def scores(self, df: DataFrame) -> Column:
        b = self.model.binned
        apply = F.pandas_udf(_apply(self.model.trees, b.cuts, self.model.start[0], self.model.booster.rate), "array<double>")
        return apply(*[feature(c) for c in b.features])

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the score, or the class of the greatest score (ties to the first)."""
        b, s = self.model.binned, self.scores(df)
        if self.task != "classification":
            return df.withColumn("prediction", s[0])
        if len(b.classes) <= 2:
            index = F.when(s[0] > 0, len(b.classes) - 1).otherwise(0)
        else:
            index = F.transform(F.array(s), lambda x: F.array_position(x, F.array_max(x)) - 1)[0]
        return df.withColumn("prediction", class_of(index, b.classes, b.label_type))


def _apply(trees: list, cuts: list, start: np.ndarray, rate: float):
    def work(*columns: pd.Series) -> pd.Series:
        bins = bin_matrix([c.to_numpy(np.float64, na_value=np.nan) for c in columns], cuts)
        f = np.repeat(start[:, None], bins.shape[1], axis=1)
        for own in trees:
            for k, t in enumerate(own):
                f[k] += rate * t.value[t.leaves(bins), 0]
        return pd.Series(list(f.T))
    return work


NOTES = {
    "xgb": "second-order trees over quantile bins; no row or column sampling",
    "lgbm": "best-first trees over quantile bins; no feature bundling, no sampling by gradient",
    "catboost": "symmetric trees by summed second-order gain, 1,000 rounds at rate 0.03; no ordered boosting, no target statistics",
}


def fit_boosting(df: DataFrame, features: list[str], target: str, name: str, task: str, params: dict) -> BoostedFitted:
    binned = prepare(df, features, target, task)
    booster = booster_for(name, params)
    fitted = BoostedFitted(name, task, boost(binned, booster))
    fitted.note = NOTES.get(booster.kind)
    return fitted


# ------------------------------------------------------------------ search
def cv_boosting(train: DataFrame, features: list[str], target: str, name: str, task: str, combos: list[tuple[int, dict]], k_folds: int) -> list[dict]:
    """Mean held-out score (r2 / accuracy) of every combination: all folds in the same rounds, and fewer rounds read from more."""
    binned = prepare(train, features, target, task, None, "fold")
    classes, d = len(binned.classes) if task == "classification" else 0, len(features)
    groups: dict = {}
    for cid, params in combos:
        rest = tuple(sorted((k, v) for k, v in params.items() if k != "n_estimators"))
        groups.setdefault(rest, []).append((cid, params, booster_for(name, params).rounds))
    out = []
    for own in groups.values():
        most = max(own, key=lambda o: o[2])
        model = boost(binned, booster_for(name, most[1]), list(range(k_folds)))
        sizes = sorted({o[2] for o in own})
        found = held_out(model, sizes, classes, d)
        for cid, params, rounds in own:
            scores = [found[rounds, f] for f in range(k_folds)]
            out.append({"combo_id": cid, "params": params, "mean_score": float(np.mean(scores)), "std_score": float(np.std(scores))})
    return sorted(out, key=lambda s: [c for c, _ in combos].index(s["combo_id"]))


def held_out(model: Boosted, sizes: list[int], classes: int, d: int) -> dict:
    """{(rounds, fold): score} of every fit on the fold that it left out."""
    rate, start, trees, folds, mean = model.booster.rate, model.start, model.trees, model.folds, model.binned.mean
    outputs = start.shape[1]

    def work(batches):
        rows = []
        for b in blocks_in(batches, d):
            for i, fold in enumerate(folds):
                own = np.flatnonzero(b.fold == fold)
                if not len(own):
                    continue
                f, bins, y, c = np.repeat(start[i][:, None], len(own), axis=1), b.bins[:, own], b.y[own], b.c[own].astype(float)
                for turn in range(max(sizes) + 1):
                    if turn in sizes:
                        if classes:
                            e = (c * (((f[0] > 0) if classes == 2 else f.argmax(0)) == y)).sum()
                        else:
                            e = (c * (y - f[0]) ** 2).sum()
                        z = y - mean
                        rows.append((fold, turn, c.sum(), e, (c * z).sum(), (c * z * z).sum()))
                    if turn < len(trees):
                        for k in range(outputs):
                            t = trees[turn][i * outputs + k]
                            f[k] += rate * t.value[t.leaves(bins), 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), *[pa.float64()] * 4))],
                                         names=["fold", "rounds", "n", "e", "z", "zz"])
    found = model.binned.blocks.mapInArrow(work, "fold int, rounds int, n double, e double, z double, zz double") \
        .groupBy("fold", "rounds").agg(*[F.sum(x).alias(x) for x in ("n", "e", "z", "zz")]).collect()
    out = {}
    for r in found:
        spread = r.zz - r.z ** 2 / r.n
        out[r.rounds, r.fold] = r.e / r.n if classes else 1.0 - r.e / spread if spread > 0 else float(r.e == 0)
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
