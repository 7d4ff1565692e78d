"""Many logistic regressions at once: all penalties and folds of a search in the same passes.

The rows are packed once into blocks of a matrix, a class and a count. Every
iteration is one pass: tasks multiply their blocks by the stacked weights of all
models and sum losses and gradients, which are added up in two steps; the
driver moves each model on by its own L-BFGS step (a model that needs a
shorter step only asks for its point again). Models have the size of their
weights, (classes x features), whatever the number of rows.

Objective of a model: mean log loss of its rows + |w|^2 / (2 C n), the
intercepts free; two classes have one score, more have a joint softmax.
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

from fathom.bundle import quote
from fathom.plans.binned import feature
from fathom.plans.forest import class_of
from fathom.session import written

#: Rows of a block, L-BFGS memory, and groups of the first sum.
BLOCK, MEMORY, GROUPS = 4096, 10, 16


def _pack(d: int):
    """(x0.., y, fold, c) -> blocks."""
    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                p = b.slice(at, BLOCK)
                x = np.column_stack([p.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)] + [np.ones(p.num_rows)])
                rest = [p.column(d + k).to_numpy(zero_copy_only=False).astype(float) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([p.num_rows], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, *rest))],
                                                 names=["n", "x", "y", "fold", "c"])
    return work


def blocks_of(df: DataFrame, features: list[str], target: str, fold: str | None) -> tuple[DataFrame, list]:
    """Packed blocks of the complete rows, equal ones counted, and the classes."""
    rows = df.where(F.col(quote(target)).isNotNull())
    classes = sorted(r[0] for r in rows.select(quote(target)).distinct().collect())            # one row for each class
    at = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    cols = [f"x{i}" for i in range(len(features))]
    rows = rows.select(*[feature(c).alias(x) for c, x in zip(features, cols)], at[F.col(quote(target))].alias("y"),
                       (F.col(quote(fold)) if fold else F.lit(-1)).cast("int").alias("fold"))
    if cols:
        rows = rows.where(" and ".join(f"{x} is not null and not isnan({x})" for x in cols))
    counted = written(rows.groupBy(*cols, "y", "fold").agg(F.count(F.lit(1)).alias("c")), "logistic_rows")
    n = max(4, math.ceil(counted.count() / (1 << 18)))
    dealt = counted.repartition(n, *cols, "y", "fold").sortWithinPartitions(*cols, "y", "fold")
    return written(dealt.mapInArrow(_pack(len(features)), "n int, x binary, y binary, fold binary, c binary"), "logistic_blocks"), classes


def _unpacked(batches, width: int):
    for b in batches:
        for r in b.to_pylist():
            yield (np.frombuffer(r["x"]).reshape(r["n"], width), *(np.frombuffer(r[k]) for k in ("y", "fold", "c")))


def losses(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed log losses and gradients of models ``weights`` (models, outputs, columns) with row weights w (models, rows)."""
    z = np.einsum("nd,mkd->mkn", x, weights, optimize=True)
    if k == 2:
        z = z[:, 0]
        loss = (w * (np.logaddexp(0, z) - z * (y == 1))).sum(1)
        r = (w * (1 / (1 + np.exp(-z)) - (y == 1)))[:, None]
    else:
        top = z.max(1, keepdims=True)
        e = np.exp(z - top)
        total = e.sum(1, keepdims=True)
        own = np.take_along_axis(z, np.broadcast_to(y.astype(int)[None, None], (len(z), 1, len(y))), 1)
        loss = (w * (np.log(total) + top - own)[:, 0]).sum(1)
        r = w[:, None] * (e / total - (np.arange(k)[:, None] == y))
    return loss, np.einsum("mkn,nd->mkd", r, x, optimize=True)


def _pass(weights: np.ndarray, folds: np.ndarray, k: int, width: int):
    """Blocks -> (part, sums): rows, losses and gradients of all models."""
    def work(batches):
        sums = np.zeros((len(folds), 2 + weights[0].size))
        for x, y, fold, c in _unpacked(batches, width):
            w = c * (fold[None] != folds[:, None])
            loss, grad = losses(x, y, w, weights, k)
            sums += np.column_stack([w.sum(1), loss, grad.reshape(len(folds), -1)])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])
    return work


def _added(key, parts):
    return pd.DataFrame({"sums": [sum(np.frombuffer(s) for s in sorted(parts["sums"])).tobytes()]})


class Descent:
    """L-BFGS of one model, one evaluated point at a time."""

    def __init__(self, size: int, tol: float, most: int):
        self.at, self.point, self.done = None, np.zeros(size), False
        self.tol, self.most, self.turns, self.step, self.pairs = tol, most, 0, 1.0, []

    def told(self, value: float, grad: np.ndarray) -> None:
        """The objective and its gradient at ``point``; sets the next ``point``."""
        if self.at is not None:
            x, v, g, direction = self.at
            slope = g @ direction
            # where a decrease is less than what rounding hides, the slope decides: it must have fallen
            level = value <= v + 1e-12 * abs(v) and grad @ direction <= -0.9998 * slope
            if value > v + 1e-4 * self.step * slope and not level and self.step > 1e-10:
                self.step *= 0.5
                self.point = x + self.step * direction
                return
            s, y = self.point - x, grad - g
            if s @ y > 1e-12 * (y @ y) and s @ y > 0:
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
            self.turns += 1
            stuck = self.step <= 1e-10
        else:
            stuck = False
        if np.abs(grad).max(initial=0.0) <= self.tol or self.turns >= self.most or stuck:
            self.done = True
            return
        q, used = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(q).sum())
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += (a - (y @ q) / (s @ y)) * s
        self.at = (self.point, value, grad, -q)
        self.step = 1.0
        self.point = self.point - q


def descend(blocks: DataFrame, d: int, k: int, models: list[tuple[float, int]], tol: float, most: int) -> tuple[np.ndarray, int]:
    """Weights (models, outputs, d + 1) of models (C, fold left out or -2), and the number of passes."""
    outputs, width = (1 if k == 2 else k), d + 1
    runs = [Descent(outputs * width, tol, most) for _ in models]
    passes = 0
    while live := [i for i, r in enumerate(runs) if not r.done]:
        weights = np.stack([runs[i].point for i in live]).reshape(len(live), outputs, width)
        folds = np.array([models[i][1] for i in live], float)
        found = blocks.mapInArrow(_pass(weights, folds, k, width), "sums binary").groupBy(F.spark_partition_id() % GROUPS).applyInPandas(_added, "sums binary").collect()
        passes += 1
        sums = sum(np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.sums)).reshape(len(live), -1)
        for i, row in zip(live, sums):
            n, c = max(1.0, row[0]), models[i][0]
            free = runs[i].point.reshape(outputs, width).copy()
            free[:, -1] = 0.0                                       # intercepts are not drawn to 0
            value = row[1] / n + (free ** 2).sum() / (2 * c * n)
            runs[i].told(value, row[2:] / n + free.ravel() / (c * n))
    return np.stack([r.point for r in runs]).reshape(len(models), outputs, width), passes


@dataclass
class LogisticFitted:
    name: str
    task: str
    features: list
    weights: np.ndarray
    classes: list
    label_type: object
    note: str | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the class of the greatest score (ties to the first); null without a complete row."""
        weights = self.weights

        def work(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns] + [np.ones(len(columns[0]))])
            z = x @ weights.T
            best = (z[:, 0] > 0).astype(float) if len(weights) == 1 else np.nan_to_num(z, nan=-np.inf).argmax(1).astype(float)
            return pd.Series(np.where(np.isnan(x).any(1), np.nan, best))
        found = F.pandas_udf(work, "double")(*[feature(c) for c in self.features])
        return df.withColumn("prediction", F.when(F.isnan(found) | found.isNull(), None).otherwise(class_of(F.coalesce(F.nanvl(found, F.lit(0.0)), F.lit(0.0)), self.classes, self.label_type)))


def fit_logistic(df: DataFrame, features: list[str], target: str, params: dict) -> LogisticFitted:
    blocks, classes = blocks_of(df, features, target, None)
    weights, _ = descend(blocks, len(features), len(classes), [(float(params.get("C", 1.0)), -2)], float(params.get("tol", 1e-4)), int(params.get("max_iter", 100)))
    return LogisticFitted("LogisticRegression", "classification", list(features), weights[0], classes, df.schema[target].dataType)


def _hits(weights: np.ndarray, folds: np.ndarray, k: int, width: int):
    def work(batches):
        rows = []
        for x, y, fold, c in _unpacked(batches, width):
            for m, f in enumerate(folds.tolist()):
                own = fold == f
                z = x[own] @ weights[m].T
                hit = ((z[:, 0] > 0) if k == 2 else z.argmax(1)) == y[own]
                rows.append((m, float(c[own].sum()), float(c[own][hit].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.float64()))], names=["m", "n", "hits"])
    return work


def cv_logistic(train: DataFrame, features: list[str], target: str, combos: list[tuple[int, dict]], k_folds: int) -> list[dict]:
    """Mean held-out accuracy of every combination: all (combination, fold) models in the same passes."""
    blocks, classes = blocks_of(train, features, target, "fold")
    k, out, found = len(classes), [], {}
    groups: dict = {}
    for cid, p in combos:
        groups.setdefault((float(p.get("tol", 1e-4)), int(p.get("max_iter", 100))), []).append((cid, float(p.get("C", 1.0))))
    for (tol, most), own in groups.items():
        models = [(c, f) for _, c in own for f in range(k_folds)]
        weights, _ = descend(blocks, len(features), k, models, tol, most)
        hits = blocks.mapInArrow(_hits(weights, np.array([f for _, f in models], float), k, len(features) + 1), "m int, n double, hits double") \
            .groupBy("m").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
        score = {r.m: r.hits / r.n for r in hits if r.n}
        for i, (cid, _) in enumerate(own):
            found[cid] = [score.get(i * k_folds + f, 0.0) for f in range(k_folds)]
    for cid, params in combos:
        out.append({"combo_id": cid, "params": params, "mean_score": float(np.mean(found[cid])), "std_score": float(np.std(found[cid]))})
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
