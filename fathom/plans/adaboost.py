"""AdaBoost over the shared binned table: R2 with weighted resampling, and SAMME.

A round is a pass that sums the weights of every block, the growth of one small
tree, and a pass that measures its error. Weights are not stored: they follow
from the trees so far.

R2 draws as many rows as there are, with replacement, by the inverse of the
weights' distribution: blocks are laid one after another by their number, and
draw i takes the row that holds the place ``(i + u_i) / n`` of all weight, with
u_i from a hash of i and the round (one uniform number in each n-th of the
weight, so a row is drawn n times its share on average). A task needs only the
sum before its block, so nothing is shuffled, and blocks hold the same rows
however the input is laid out.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from fathom.plans import trees as T
from fathom.plans.binned import Binned, bin_matrix, blocks_in, feature, prepare
from fathom.plans.forest import class_of
from fathom.plans.trees import draws


def drawn(weight: np.ndarray, start: float, total: float, n: int, turn: int) -> np.ndarray:
    """How often each cell is drawn: ``weight`` are the cells' shares of ``total``, ``start`` the sum before the first."""
    ends = (start + np.cumsum(weight)) * (n / total)
    low = start * (n / total)
    i = np.arange(max(0, math.floor(low) - 1), min(n, math.ceil(ends[-1]) + 1)) if len(ends) else np.zeros(0, np.int64)
    place = i + draws(i.astype(np.uint64), turn)
    place = place[(place >= low) & (place < (ends[-1] if len(ends) else 0.0))]
    return np.bincount(np.searchsorted(ends, place, side="right"), minlength=len(weight))[:len(weight)]


class Weights(T.Source):
    """Cells with the weights after the rounds of ``history``: (tree, what a round did to them)."""

    def __init__(self, classes: int, mean: float, rate: float, history: list, n: int):
        self.classes, self.mean, self.rate, self.history, self.n = classes, mean, rate, history, n
        self.starts: dict = {}
        self.total = 1.0

    def errors(self, tree, block) -> np.ndarray:
        found = tree.value[tree.leaves(block.bins)]
        if self.classes:
            return (found.argmax(1) != block.y).astype(float)
        return np.abs(block.y - self.mean - found[:, 0])

    def weight(self, block) -> np.ndarray:
        """Weight of all rows of each cell."""
        log_w = np.zeros(block.n)
        for tree, step, scale in self.history:
            e = self.errors(tree, block) / scale
            log_w += step * e if self.classes else step * (1.0 - e) * self.rate
        return block.c * np.exp(log_w)

    def stats(self, block, member):
        w = self.weight(block)
        if self.classes:
            rows = np.flatnonzero(w > 0)
            return rows, np.column_stack([block.c[rows], w[rows] / self.total, block.y[rows]])
        s = drawn(w, self.starts[block.block], self.total, self.n, len(self.history))
        rows = np.flatnonzero(s)
        return rows, np.column_stack([np.minimum(s[rows], block.c[rows]), s[rows] * (block.y[rows] - self.mean), s[rows]]).astype(float)


def _totals(d: int, source: Weights):
    def work(batches):
        for b in blocks_in(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array([b.block]), pa.array([float(source.weight(b).sum())])], names=["block", "w"])
    return work


def _measured(d: int, source: Weights, tree):
    """Greatest error of rows with weight, and the weighted sum of errors."""
    def work(batches):
        for b in blocks_in(batches, d):
            w, e = source.weight(b), source.errors(tree, b)
            yield pa.RecordBatch.from_arrays([pa.array([float(e[w > 0].max(initial=0.0))]), pa.array([float((w * e).sum())])], names=["top", "we"])
    return work


@dataclass
class AdaFitted:
    name: str
    task: str
    binned: Binned
    members: list               # (tree, weight)
    note: str | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the weighted median of the trees, or the class of the greatest weight (ties to the first)."""
        b = self.binned
        apply = F.pandas_udf(_apply(self.members, b.cuts, b.mean, len(b.classes) if self.task == "classification" else 0), "double")
        found = apply(*[feature(c) for c in b.features])
        return df.withColumn("prediction", class_of(found, b.classes, b.label_type) if self.task == "classification" else found)


def weighted_median(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each column the least value at which the weights reach half of their sum."""
    order = np.argsort(values, axis=0, kind="stable")
    upto = np.cumsum(weights[order], axis=0)
    at = (upto >= 0.5 * upto[-1]).argmax(0)
    return np.take_along_axis(values, np.take_along_axis(order, at[None], 0), 0)[0]


def _apply(members: list, cuts: list, mean: float, classes: int):
    weights = np.array([w for _, w in members])

    def work(*columns: pd.Series) -> pd.Series:
        bins = bin_matrix([c.to_numpy(np.float64, na_value=np.nan) for c in columns], cuts)
        if not classes:
            return pd.Series(mean + weighted_median(np.stack([t.value[t.leaves(bins), 0] for t, _ in members]), weights))
        votes = np.zeros((classes, bins.shape[1]))
        for t, w in members:
            np.add.at(votes, (t.value[t.leaves(bins)].argmax(1), np.arange(bins.shape[1])), w)
        return pd.Series(votes.argmax(0).astype(float))
    return work


def fit_adaboost(df: DataFrame, features: list[str], target: str, task: str, params: dict, key: list[str] | None = None) -> AdaFitted:
    """M22 SAMME (depth-1 trees) / M10 AdaBoost.R2 (depth-3 trees, linear loss)."""
    binned = prepare(df, features, target, task, key)
    classes, d = len(binned.classes) if task == "classification" else 0, len(features)
    rounds, rate = int(params.get("n_estimators") or 50), float(params.get("learning_rate", 1.0))
    seed = 42 if params.get("random_state") is None else int(params["random_state"])
    rule = T.Rule("gini", classes, max_depth=1) if classes else T.Rule(max_depth=3)
    history, members = [], []
    for turn in range(rounds):
        source = Weights(classes, binned.mean, rate, list(history), binned.n_rows)
        sums = sorted((r.block, r.w) for r in binned.blocks.mapInArrow(_totals(d, source), "block bigint, w double").collect())    # one row for each block
        ends = np.cumsum([w for _, w in sums])
        source.total = float(ends[-1]) if len(ends) else 1.0
        source.starts = {b: float(e - w) for (b, w), e in zip(sums, ends)}
        tree = T.joined(T.grow(binned, [0], [turn], source, rule, seed + turn, collect=True))[0]
        m = binned.blocks.mapInArrow(_measured(d, source, tree), "top double, we double").agg(F.max("top").alias("top"), F.sum("we").alias("we")).first()
        if classes:
            error = m.we / source.total
            if error <= 0:
                members.append((tree, 1.0))
                break
            if error >= 1.0 - 1.0 / classes:
                if not members:
                    raise ValueError("base classifier is no better than chance")
                break
            step = rate * (math.log((1 - error) / error) + math.log(classes - 1))
            members.append((tree, step))
            history.append((tree, step, 1.0))
            continue
        if not m.top:
            members.append((tree, 1.0))
            break
        loss = m.we / (m.top * source.total)
        if loss >= 0.5:
            if not members:
                members.append((tree, 1.0))
            break
        step = math.log(loss / (1 - loss))
        members.append((tree, -rate * step))
        history.append((tree, step, m.top))
    return AdaFitted("AdaBoostClassifier" if classes else "AdaBoostRegressor", task, binned, members)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
