"""Forests over the shared binned table: random forests, bagged and single trees, extremely randomised trees.

All trees of a forest are grown in the same passes (``trees.grow``); a search
over ``n_estimators``, ``max_depth`` and ``min_samples_split`` grows one forest
for all folds and combinations: the first trees of a larger forest are the
smaller one, and a tree cut off at a depth or at nodes of too few rows is the
tree grown with that bound, since no node's draw depends on them.

Samples of keyed rows that fall into few distinct cells (bins, target, fold) are
drawn once: a cell carries its weight in every tree, and the forest is grown and
scored from these cells (``gathered``). Where nothing is sampled, equal rows are
counted and no row is told from another by its key.

A model is a few levels on the driver and a table of the trees below. It is
joined on the driver if it has at most ``MODEL`` bytes; else rows are routed to
(tree, node) and meet the tree's part there, in shares of a bounded size.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fathom.bundle import quote
from fathom.plans import trees as T
from fathom.plans.binned import BLOCK, BLOCKS, Binned, bin_matrix, binned_column, blocks_in, bootstrap, constants, feature, pack_cells, prepare
from fathom.plans.trees import Tree
from fathom.session import written

#: Bytes of a model that every task may hold, and bytes of values that are added up in one group.
MODEL, ADDED = 1 << 26, 1 << 26
#: Routed rows of one (tree, node) that meet its tree in one group, about.
SHARE = 1 << 20
#: Bytes of the weights that distinct cells carry, and rows for each of them at least.
WEIGHTS, ALIKE = 1 << 25, 4
FULL = [(None, 0)]


class Sampled(T.Source):
    """Members ``(tree, fold)``: a Poisson sample of all rows outside the fold, or every such row once."""

    def __init__(self, numbers, sampled: bool, classes: int, mean: float, seed: int):
        self.sampled, self.classes, self.mean = sampled, classes, mean
        self.abc = {t: constants(t, seed) for t in numbers}

    def weights(self, block, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each cell that a tree's sample has, at most, and how often they are in it."""
        w = bootstrap(block, self.abc[tree]) if self.sampled else block.c
        return np.minimum(w, block.c), w

    def stats(self, block, member):
        tree, fold = member
        n, w = self.weights(block, tree)
        if fold >= 0:
            w = np.where(block.fold == fold, 0, w)
        rows = np.flatnonzero(w)
        n, w, y = n[rows].astype(float), w[rows].astype(float), block.y[rows]
        return rows, np.column_stack([n, w, y] if self.classes else [n, w * (y - self.mean), w])


class Weighted(Sampled):
    """The same members over cells that carry their weights: ``f`` holds (trees, 2, cells)."""

    def __init__(self, numbers, classes: int, mean: float):
        self.place, self.classes, self.mean = {t: i for i, t in enumerate(numbers)}, classes, mean

    def of(self, block):
        block.f = np.frombuffer(block.f, np.int64).reshape(len(self.place), 2, block.n)
        return block

    def weights(self, block, tree):
        return tuple(block.f[self.place[tree]])


# ------------------------------------------------------------------ few distinct cells
def _contents(b) -> np.ndarray:
    """Bins, target and fold of a block's cells, one value of bytes each."""
    m = np.concatenate([b.bins.T, np.ascontiguousarray(b.y).view(np.uint8).reshape(b.n, 8), b.fold.view(np.uint8)[:, None]], axis=1)
    return np.ascontiguousarray(m).view(f"V{m.shape[1]}").ravel()


def _few_cells(d: int, most: int):
    """Blocks -> (cell, c): the task's distinct cells and their rows, or null once if they are more than ``most``."""
    def work(batches):
        seen: dict | None = {}
        for raw in batches:
            for b in blocks_in([raw], d) if seen is not None else ():
                own, at = np.unique(_contents(b), return_inverse=True)
                for x, c in zip(own.tolist(), np.bincount(at, weights=b.c).tolist()):
                    seen[x] = seen.get(x, 0) + int(c)
                if len(seen) > most:
                    seen = None
                    break
        rows = [(None, 0)] if seen is None else list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["cell", "c"])
    return work


def _weights_of(cells: list[bytes], d: int, source: Sampled, numbers: list[int]):
    """Blocks -> (tree, sums): the task's weights of the distinct cells in each tree."""
    def work(batches):
        place, total = {x: i for i, x in enumerate(cells)}, np.zeros((len(numbers), 2, len(cells)), np.int64)
        for b in blocks_in(batches, d):
            own, at = np.unique(_contents(b), return_inverse=True)
            to = np.array([place[x] for x in own.tolist()])
            for i, tree in enumerate(numbers):
                for k, w in enumerate(source.weights(b, tree)):
                    total[i, k, to] += np.bincount(at, weights=w, minlength=len(own)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["tree", "sums"])
    return work


def gathered(binned: Binned, source: Sampled, numbers: list[int]) -> tuple[Binned, DataFrame, Sampled]:
    """The table, blocks and source that a forest of the trees ``numbers`` is grown from: one block of the distinct cells with their
    weights where these are few, else what is given. Sums of whole numbers: the trees are the same."""
    d, most = len(binned.features), min(BLOCK, WEIGHTS // (16 * len(numbers)))
    if not source.sampled or not most:
        return binned, binned.blocks, source
    found = binned.blocks.mapInArrow(_few_cells(d, most), "cell binary, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).limit(most + 2).collect()
    if not found or len(found) > most or len(found) * ALIKE > binned.n_rows or any(r.cell is None for r in found):
        return binned, binned.blocks, source
    found = sorted((bytes(r.cell), r.c) for r in found)
    cells, n = [x for x, _ in found], len(found)
    m = np.frombuffer(b"".join(cells), np.uint8).reshape(n, d + 9)
    parts = (m[:, :d].T, m[:, d:d + 8], np.array([c for _, c in found], np.int64), m[:, -1], np.zeros(n, np.int64), np.zeros(n, np.int64))
    row = (0, n, *(np.ascontiguousarray(x).tobytes() for x in parts))

    def added(key, sums):
        return pd.DataFrame({"tree": [key[0]], "sums": [sum(np.frombuffer(x, np.int64) for x in sums["sums"]).tobytes()]})

    def one_block(key, sums):
        return pd.DataFrame([(*row, b"".join(sums.sort_values("tree")["sums"]))], columns=[*names, "f"])
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    sums = binned.blocks.mapInArrow(_weights_of(cells, d, source, sorted(numbers)), "tree int, sums binary") \
        .groupBy("tree").applyInPandas(added, "tree int, sums binary")
    # one group of at most WEIGHTS bytes
    blocks = written(sums.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(one_block, f"{BLOCKS}, f binary"), "weighted_cells")
    return replace(binned, blocks=blocks.select(*names), n_rows=n), blocks, Weighted(sorted(numbers), source.classes, source.mean)


#: Name -> (trees by default, bootstrap samples, features tried at a node, one random cut for each feature).
KINDS = {
    "RandomForestRegressor": (100, True, "all", False), "RandomForestClassifier": (100, True, "sqrt", False),
    "BaggingRegressor": (10, True, "all", False), "BaggingClassifier": (10, True, "all", False),
    "DecisionTreeRegressor": (1, False, "all", False), "DecisionTreeClassifier": (1, False, "all", False),
    "ExtraTreesRegressor": (100, False, "all", True), "ExtraTreesClassifier": (100, False, "sqrt", True),
}
NESTED = ("n_estimators", "max_depth", "min_samples_split")


def rule_for(name: str, params: dict, d: int, classes: int) -> T.Rule:
    _, _, tried, random_cuts = KINDS[name]
    depth = params.get("max_depth")
    return T.Rule("gini" if classes else "newton", classes, max_depth=None if depth is None else int(depth),
                  min_split=int(params.get("min_samples_split", 2)), min_rows=float(params.get("min_samples_leaf", 1)),
                  max_features=max(1, int(math.sqrt(d))) if tried == "sqrt" else None, random_cuts=random_cuts)


def _seed(params: dict) -> int:
    seed = params.get("random_state")
    return 42 if seed is None else int(seed)


# ------------------------------------------------------------------ routing cells through a forest
def _route(tops: list, nodes: list, members: list, d: int, variants: list, sizes: list[int], k: int, score: bool, size: int):
    """Blocks -> (block, part, sums, ...) of what ends in the upper levels, and (member, node, ...) of what goes on.

    ``sums`` are (sizes, variants, cells, values); with ``score`` a member sees the cells of its own fold."""
    below = [np.isin(np.arange(len(t.feature)), n) for t, n in zip(tops, nodes)]
    first_of = np.array(sizes)

    def work(batches):
        for b in blocks_in(batches, d):
            sums = np.zeros((len(sizes), len(variants), b.n, k))
            on = []
            for m, (tree, fold) in enumerate(members):
                rows = np.flatnonzero(b.fold == fold) if score else np.arange(b.n)
                if not len(rows):
                    continue
                top = tops[m]
                ends = top.truncated(b.bins[:, rows], variants)
                goes = below[m][ends] if below else np.zeros(ends.shape, bool)
                value = np.where(goes[..., None], 0.0, top.value[ends])
                sums[np.ix_(np.flatnonzero(tree < first_of), np.arange(len(variants)), rows)] += value
                if goes.any():
                    node = np.where(goes, ends, -1).max(0)
                    order = np.argsort(node, kind="stable")
                    for n in np.unique(node[node >= 0]).tolist():
                        at = order[np.searchsorted(node[order], n):np.searchsorted(node[order], n, side="right")]
                        skip = sum(1 << v for v in range(len(variants)) if not goes[v, at[0]])
                        for part in np.unique(rows[at] // size).tolist():
                            own = rows[at][rows[at] // size == part]
                            on.append((b.block, part, m, n, skip, len(own), own.astype(np.int32).tobytes(), np.ascontiguousarray(b.bins[:, own]).tobytes()))
            out = [(b.block, p, -1, -1, 0, min(size, b.n - p * size), np.arange(p * size, min(b.n, (p + 1) * size), dtype=np.int32).tobytes(),
                    np.ascontiguousarray(sums[:, :, p * size:(p + 1) * size]).tobytes()) for p in range(-(-b.n // size))] + on
            for at in range(0, len(out), 256):
                part = out[at:at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in ROUTED.split(", ")])
    return work


ROUTED = "block bigint, part int, member int, node int, skip bigint, n int, at binary, data binary"
SUMS = "block bigint, part int, member int, n int, at binary, data binary"


def _below(d: int, variants: list):
    """Routed cells of one (member, node) and its tree -> their values."""
    def work(key, cells, tree):
        if not len(cells) or not len(tree):
            return pd.DataFrame({c.split()[0]: [] for c in SUMS.split(", ")})
        t, depth = Tree.unpacked(tree["tree"].iloc[0]), int(tree["depth"].iloc[0])
        rows = list(cells.itertuples())
        ends = t.truncated(np.concatenate([np.frombuffer(r.data, np.uint8).reshape(d, r.n) for r in rows], axis=1), variants, depth)
        value, out, at = t.value[ends], [], 0
        for r in rows:
            own = np.ascontiguousarray(value[:, at:at + r.n])
            at += r.n
            for v in range(len(variants)):
                if r.skip >> v & 1:
                    own[v] = 0.0
            out.append((r.block, r.part, r.member, r.n, r.at, own.tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SUMS.split(", ")])
    return work


def part_size(members: int, variants: list, k: int) -> int:
    """Cells of a block whose values of all members are added up in one group."""
    return max(64, min(BLOCK, ADDED // (members * len(variants) * k * 8)))


def parts_of(blocks: DataFrame, size: int, *cols: str) -> DataFrame:
    """``cols`` of every block for each of its parts."""
    return blocks.select("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / size).cast("int") - 1)).alias("part"), *cols).groupBy("block", "part")


def routed_sums(grown: T.Grown, members: list, blocks: DataFrame, d: int, variants: list, sizes: list[int], k: int, score: bool) -> DataFrame:
    """``block, part, member, n, at, data``: values of cells to be added up; member -1 has the sums of the upper levels."""
    spark = blocks.sparkSession
    routed = blocks.mapInArrow(_route(grown.tops, grown.nodes, members, d, variants, sizes, k, score, part_size(len(members), variants, k)), ROUTED)
    if grown.below is None:
        return routed.select("block", "part", "member", "n", "at", "data")
    routed = written(routed, "routed")
    depth = spark.createDataFrame([(m, int(n), int(_depths(t)[n])) for m, (t, ns) in enumerate(zip(grown.tops, grown.nodes)) for n in ns], "member int, node int, depth int")
    # a node's tree is sent to as many groups as its own cells fill, not the whole table's: a row for each node that has any
    shares = written(routed.where("member >= 0").groupBy("member", "node").agg(F.ceil(F.sum("n") / SHARE).cast("int").alias("shares")), "shares")
    lower = grown.below.join(F.broadcast(depth), ["member", "node"]).join(F.broadcast(shares), ["member", "node"]) \
        .select("member", "node", "tree", "depth", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    going = routed.where("member >= 0").join(F.broadcast(shares), ["member", "node"]) \
        .withColumn("share", F.pmod(F.xxhash64("block", "part"), F.col("shares")).cast("int")).drop("shares")
    found = going.groupBy("member", "node", "share").cogroup(lower.groupBy("member", "node", "share")).applyInPandas(_below(d, variants), SUMS)
    return found.unionByName(routed.where("member < 0").select("block", "part", "member", "n", "at", "data"))


def _depths(t: T.Tree) -> np.ndarray:
    out = np.zeros(len(t.feature), np.int64)
    for i in np.flatnonzero(t.feature >= 0).tolist():       # children come after their parents
        out[t.left[i]] = out[t.left[i] + 1] = out[i] + 1
    return out


def _added(parts: pd.DataFrame, numbers: list[int], variants: int, sizes: list[int], k: int):
    """The cells of one (block, part), in order, and their sums (sizes, variants, cells, values)."""
    base = parts[parts["member"] < 0].iloc[0]
    at = np.frombuffer(base["at"], np.int32)
    sums = np.frombuffer(base["data"]).reshape(len(sizes), variants, len(at), k).copy()
    for r in parts[parts["member"] >= 0].sort_values("member").itertuples():
        which = np.searchsorted(at, np.frombuffer(r.at, np.int32))
        value = np.frombuffer(r.data).reshape(variants, r.n, k)
        for s, size in enumerate(sizes):
            if numbers[r.member] < size:
                sums[s][:, which] += value
    return at, sums


# ------------------------------------------------------------------ search
def cv_forest(train: DataFrame, features: list[str], target: str, name: str, task: str, combos: list[tuple[int, dict]], k_folds: int,
              key: list[str] | None = None) -> list[dict]:
    """Mean held-out score (r2 / accuracy) of every combination of NESTED parameters, from one forest for all folds."""
    default, sampled, _, _ = KINDS[name]
    binned = prepare(train, features, target, task, key if sampled else None, "fold")
    classes = len(binned.classes) if task == "classification" else 0
    shape = [(int(p.get("n_estimators") or default), p.get("max_depth"), int(p.get("min_samples_split", 2))) for _, p in combos]
    sizes, variants = sorted({s[0] for s in shape}), sorted({s[1:] for s in shape}, key=lambda v: (v[0] is None, v))
    depths = [v[0] for v in variants]
    common = dict(combos[0][1], max_depth=None if None in depths else max(depths), min_samples_split=min(v[1] for v in variants))
    rule, seed = rule_for(name, common, len(features), classes), _seed(common)
    members = [(t, f) for f in range(k_folds) for t in range(max(sizes))]
    binned, blocks, source = gathered(binned, Sampled(range(max(sizes)), sampled, classes, binned.mean, seed), list(range(max(sizes))))
    grown = T.grow(binned, members, [t for t, _ in members], source, rule, seed, blocks=blocks)
    width = classes or 1
    sums = routed_sums(grown, members, binned.blocks, len(features), variants, sizes, width, True)
    numbers, mean = [t for t, _ in members], binned.mean

    def judge(key, parts, truth):
        at, total = _added(parts, numbers, len(variants), sizes, width)
        t = truth.iloc[0]
        y, c, fold = (np.frombuffer(t[n], kind)[at] for n, kind in (("y", np.float64), ("c", np.int64), ("fold", np.int8)))
        out = []
        for f in np.unique(fold).tolist():
            own = fold == f
            w = c[own].astype(float)
            for s, size in enumerate(sizes):
                for v in range(len(variants)):
                    found = total[s, v, own]
                    if classes:
                        hit = found.argmax(1) == y[own]
                        out.append((f, s, v, w.sum(), (w * hit).sum(), 0.0, 0.0))
                    else:
                        z = y[own] - mean
                        out.append((f, s, v, w.sum(), (w * (z - found[:, 0] / size) ** 2).sum(), (w * z).sum(), (w * z * z).sum()))
        return pd.DataFrame(out, columns=["fold", "s", "v", "n", "e", "z", "zz"])
    # a block's target and weights come to each of its parts
    truth = parts_of(binned.blocks, part_size(len(members), variants, width), "y", "c", "fold")
    scored = sums.groupBy("block", "part").cogroup(truth).applyInPandas(judge, "fold int, s int, v int, n double, e double, z double, zz double") \
        .groupBy("fold", "s", "v").agg(*[F.sum(x).alias(x) for x in ("n", "e", "z", "zz")]).collect()      # folds x combinations
    by: dict = {}
    for r in scored:
        if task == "classification":
            value = r.e / r.n
        else:
            spread = r.zz - r.z ** 2 / r.n
            value = 1.0 - r.e / spread if spread > 0 else float(r.e == 0)
        by.setdefault((sizes[r.s], *variants[r.v]), {})[r.fold] = value
    out = []
    for (cid, params), s in zip(combos, shape):
        scores = [by[s].get(f, 0.0) for f in range(k_folds)]
        out.append({"combo_id": cid, "params": params, "mean_score": float(np.mean(scores)), "std_score": float(np.std(scores))})
    return out


# ------------------------------------------------------------------ fitted models
def class_of(index: Column, classes: list, kind) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), (index + 1).cast("int")).cast(kind)


@dataclass
class ForestFitted:
    name: str
    task: str
    binned: Binned
    grown: T.Grown
    note: str | None = None
    trees: list | None = None

    @property
    def width(self) -> int:
        return len(self.binned.classes) if self.task == "classification" else 1

    def _prediction(self, value: Column) -> Column:
        return class_of(value, self.binned.classes, self.binned.label_type) if self.task == "classification" else value

    def _small(self) -> bool:
        if self.grown.below is None:
            return True
        return (self.grown.below.agg(F.sum(F.length("tree")).alias("b")).first().b or 0) <= MODEL

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the mean of the trees, or the class of the greatest mean share (ties to the first)."""
        if self.trees is None and self._small():
            self.trees = T.joined(self.grown)
        if self.trees is not None:
            apply = F.pandas_udf(_apply(self.trees, self.binned.cuts, self.binned.mean, self.task), "double")
            return df.withColumn("prediction", self._prediction(apply(*[feature(c) for c in self.binned.features])))
        return self._scattered(df)

    def _scattered(self, df: DataFrame) -> DataFrame:
        """Rows are routed by their bins: every distinct combination once."""
        d, n_trees = len(self.binned.features), len(self.grown.tops)
        bins = F.pandas_udf(binned_column(self.binned.cuts), "binary")(*[feature(c) for c in self.binned.features])
        rows = written(df.withColumn("__bins", bins), "scored_rows")
        cells = rows.select(F.col("__bins").alias("bins")).distinct()
        blocks = pack_cells(cells.select("bins", F.lit(0.0).alias("y"), F.lit(0).alias("fold"), F.lit(1).cast("bigint").alias("c"), F.md5("bins").alias("h")), d, cells.count())
        members = [(t, -1) for t in range(n_trees)]
        sums = routed_sums(self.grown, members, blocks, d, FULL, [n_trees], self.width, False)
        task, mean, width = self.task, self.binned.mean, self.width

        def finish(key, parts, packed):
            at, total = _added(parts, list(range(n_trees)), 1, [n_trees], width)
            own = np.frombuffer(packed["bins"].iloc[0], np.uint8).reshape(d, -1)[:, at].T
            found = total[0, 0].argmax(1).astype(float) if task == "classification" else mean + total[0, 0, :, 0] / n_trees
            return pd.DataFrame({"__of": [x.tobytes() for x in np.ascontiguousarray(own)], "__value": found})
        parts = parts_of(blocks, part_size(n_trees, FULL, width), "bins")
        found = sums.groupBy("block", "part").cogroup(parts).applyInPandas(finish, "__of binary, __value double")
        out = rows.join(found, rows["__bins"] == found["__of"], "left")
        return out.withColumn("prediction", self._prediction(F.col("__value"))).select(*[quote(c) for c in df.columns], "prediction")


def _apply(trees: list, cuts: list, mean: float, task: str):
    def work(*columns: pd.Series) -> pd.Series:
        bins = bin_matrix([c.to_numpy(np.float64, na_value=np.nan) for c in columns], cuts)
        total = 0.0
        for t in trees:
            total = total + t.value[t.leaves(bins)]
        return pd.Series(total.argmax(1).astype(float) if task == "classification" else mean + total[:, 0] / len(trees))
    return work


def fit_forest(df: DataFrame, features: list[str], target: str, name: str, task: str, params: dict, key: list[str] | None = None) -> ForestFitted:
    """A forest, bagged trees, extremely randomised trees or one tree, by ``name``."""
    default, sampled, _, _ = KINDS[name]
    binned = prepare(df, features, target, task, key if sampled else None)
    classes = len(binned.classes) if task == "classification" else 0
    n, seed = int(params.get("n_estimators") or default) if default > 1 else 1, _seed(params)
    members = [(t, -1) for t in range(n)]
    binned, blocks, source = gathered(binned, Sampled(range(n), sampled, classes, binned.mean, seed), list(range(n)))
    grown = T.grow(binned, members, list(range(n)), source, rule_for(name, params, len(features), classes), seed, blocks=blocks)
    return ForestFitted(name, task, binned, grown)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
