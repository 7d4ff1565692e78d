"""Exact k nearest neighbours over pivot cells.

A bounded sample of the training rows (by md5 of their id) are pivots; every
row lies in the cell of its nearest pivot, and a cell has a radius. A query
first meets the rows of the nearest cells that hold k rows together; its k-th
distance there bounds the search, and by the triangle inequality only cells whose
pivot is no farther than that bound plus their radius can hold a nearer row. A
second pass visits just these. Inside a cell, rows whose distance to the pivot
differs from the query's by more than the bound are left out unread, and a
product of matrices tells which of the others can be near enough to be measured.

A task holds at most ``BLOCK_ROWS`` rows of a cell and as many queries; k candidates a
query and block are merged by a window group limit. On data without clusters
all cells may have to be visited; the result is the same.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fathom.bundle import quote
from fathom.session import written

#: Rows of a side in one task, rows of a cell on average, and most pivots (a task holds all of them).
BLOCK_ROWS, CELL_ROWS, PIVOTS = 20_000, 4_096, 4_096
#: Slack of the bounds for rounding, and that of squared distances by products, in parts of the squares.
SLACK, ROUNDING = 1 + 1e-9, 1e-11


def vector(df: DataFrame, features: list[str]) -> Column:
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        return F.col(quote(features[0])).cast("array<double>")
    return F.array(*[F.col(quote(f)).cast("double") for f in features])


#: Rows that lack a feature are no neighbours, and have none.
WHOLE = "forall(vec, x -> x is not null and not isnan(x))"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows of a, rows of b), some rows at a time (about 32 MB)."""
    out = np.empty((len(a), len(b)))
    step = max(1, (32 << 20) // max(1, b.size * 8))
    for at in range(0, len(a), step):
        out[at:at + step] = np.sqrt(((a[at:at + step, None, :] - b[None]) ** 2).sum(axis=2))
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of a, row of b, distance)`` of the k nearest rows of b to each row of a that are not beyond its ``bound``: by row of a,
    then distance, then row of b.

    Products of matrices leave out what is farther by more than their rounding; the distances of the rest are those of ``distances``."""
    most = min(k, len(b))
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    with np.errstate(all="ignore"):
        about = a @ b.T
        about *= -2.0
        about += aa[:, None]
        about += bb[None]
        slack = ROUNDING * (aa + bb.max(initial=0.0))
        limit = np.square(bound * SLACK) + slack
        use = about <= limit[:, None]
        if not np.isfinite(slack).all():
            use = np.ones(about.shape, bool)                    # squares overflow: all pairs
        elif np.isinf(limit).any() or use.sum() > 64 * most * len(a):
            use &= about <= (np.partition(about, most - 1, axis=1)[:, most - 1] + 2 * slack)[:, None]
    i, j = np.nonzero(use)
    d, step = np.empty(len(i)), max(1, (32 << 20) // max(1, a.shape[1] * 8))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        d[part] = np.sqrt(((a[i[part]] - b[j[part]]) ** 2).sum(axis=1))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, np.arange(len(a)))
    kept = (np.arange(len(i)) - first[i] < most) & ~(d > bound[i] * SLACK)
    return i[kept], j[kept], d[kept]


def _matrix(column) -> np.ndarray:
    """A list column of Arrow as rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _to_cells(pivots: np.ndarray):
    """(rid, vec, y) -> with its cell and the distance to the pivot."""
    def work(batches):
        for b in batches:
            if b.num_rows:
                d = distances(_matrix(b.column("vec")), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), *b.columns], names=["cell", "far", *b.schema.names])
    return work


@dataclass
class KNNFitted:
    name: str
    task: str
    features: list
    train: DataFrame            # cell, far, rid, vec, y: a written table
    pivots: np.ndarray
    sizes: np.ndarray           # rows and radius of each cell
    radius: np.ndarray
    k: int
    label_type: T.DataType
    note: str | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        return knn_predict(self, df)


def fit_knn(df: DataFrame, features: list[str], target: str, task: str, params: dict) -> KNNFitted:
    k = int(params.get("n_neighbors", 5))
    rid = F.col(quote(params["id_col"])).cast("long") if params.get("id_col") else F.monotonically_increasing_id()
    rows = df.select(rid.alias("rid"), vector(df, features).alias("vec"), F.col(quote(target)).alias("y"))
    rows = written(rows.where("y is not null").where(WHOLE), "knn_rows")
    n = rows.count()
    p = max(1, min(PIVOTS, math.ceil(n / CELL_ROWS)))
    sample = rows.select("vec", "rid").orderBy(F.md5(F.col("rid").cast("string")), "rid").limit(p).collect()        # at most PIVOTS rows
    pivots = np.unique(np.array([r.vec for r in sample], float), axis=0) if sample else np.zeros((1, max(1, len(features))))
    kind = rows.schema["y"].dataType.simpleString()
    train = written(rows.mapInArrow(_to_cells(pivots), f"cell int, far double, rid long, vec array<double>, y {kind}"), "knn_cells")
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in train.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect():            # one row for each cell
        sizes[r.cell], radius[r.cell] = r.n, r.r
    return KNNFitted("KNeighborsRegressor" if task == "regression" else "KNeighborsClassifier", task, list(features), train, pivots, sizes, radius, k,
                     df.schema[target].dataType)


def first_cells(d: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query (row of distances to the pivots) the nearest cells that hold k rows together."""
    nearest = np.where(sizes > 0, d, np.inf).argmin(1)
    out = [nearest[i:i + 1] for i in range(len(d))]
    for i in np.flatnonzero(sizes[nearest] < k).tolist():
        order = np.argsort(d[i], kind="stable")
        order = order[sizes[order] > 0]
        out[i] = order[:int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1]
    return out


def other_cells(d: np.ndarray, bound: np.ndarray, radius: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(queries, cells): cells that the bound does not exclude."""
    return (d <= (bound[:, None] + radius[None]) * SLACK) & (sizes > 0)[None]


def _visits(pivots: np.ndarray, sizes: np.ndarray, radius: np.ndarray, k: int, bounded: bool):
    """(qid, vec[, bound]) -> a row for each cell to visit; with bounds only those not visited at first."""
    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = distances(_matrix(b.column("vec")), pivots)
            first = first_cells(d, sizes, k)
            if bounded:
                bound = b.column("bound").to_numpy(zero_copy_only=False).astype(float)
                more = other_cells(d, bound, radius, sizes)
                for i, f in enumerate(first):
                    more[i, f] = False
                q, cell = np.nonzero(more)
            else:
                bound = np.full(len(d), np.inf)
                q = np.repeat(np.arange(len(d)), [len(f) for f in first])
                cell = np.concatenate(first) if first else np.zeros(0, np.int64)
            qid = b.column("qid").to_numpy()
            for at in range(0, len(q), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(cell[part], pa.int32()), pa.array(qid[q[part]]), pa.array(d[q[part], cell[part]]),
                                                  pa.array(bound[q[part]]), b.column("vec").take(pa.array(q[part]))], names=["cell", "qid", "q_far", "bound", "vec"])
    return work


def _nearest(k: int):
    """Queries and rows of one cell -> the k nearest rows of each query, ties to the smaller id."""
    def work(queries, rows):
        if not len(queries) or not len(rows):
            return pd.DataFrame({"qid": [], "d": [], "rid": [], "y": []})
        rows = rows.sort_values("rid", kind="stable")                 # a stable sort then takes the least id of equal distances
        b, far = np.stack(rows["vec"].to_numpy()).astype(float), rows["far"].to_numpy()
        rid, y, out = rows["rid"].to_numpy(), rows["y"].to_numpy(), []
        for at in range(0, len(queries), 256):
            q = queries.iloc[at:at + 256]
            q_far, bound = q["q_far"].to_numpy(), q["bound"].to_numpy()
            # rows that some of these queries may be near to, by their distances to the pivot
            use = (far >= ((q_far - bound * SLACK) / SLACK).min()) & (far <= ((q_far + bound * SLACK) * SLACK).max())
            if not use.any():
                continue
            i, j, d = near_pairs(np.stack(q["vec"].to_numpy()).astype(float), b[use], k, bound)
            out.append(pd.DataFrame({"qid": q["qid"].to_numpy()[i], "d": d, "rid": rid[use][j], "y": y[use][j]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"qid": [], "d": [], "rid": [], "y": []})
    return work


def _parts(sizes: dict) -> Column:
    """Parts of BLOCK_ROWS that the rows of a cell are cut into; ``sizes`` is by cell."""
    large = {c: math.ceil(n / BLOCK_ROWS) for c, n in sizes.items() if n > BLOCK_ROWS}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("cell")], F.lit(1)) if large else F.lit(1)


def _candidates(model: KNNFitted, queries: DataFrame, bounded: bool) -> DataFrame:
    visits = queries.mapInArrow(_visits(model.pivots, model.sizes, model.radius, model.k, bounded), "cell int, qid long, q_far double, bound double, vec array<double>")
    # the rows of a large cell are cut into blocks, and the queries that visit it into shards: every pair is a group of bounded size
    seen = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}       # one row for each cell
    blocks, shards = _parts(dict(enumerate(model.sizes.tolist()))), _parts(seen)
    left = visits.withColumn("shard", F.pmod(F.xxhash64("qid"), shards).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = model.train.withColumn("block", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    by = ["cell", "block", "shard"]
    kind = model.train.schema["y"].dataType.simpleString()
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_nearest(model.k), f"qid long, d double, rid long, y {kind}")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("d", "rid"))).where(F.col("place") <= k)


def _second(model: KNNFitted, queries: DataFrame, near: DataFrame) -> DataFrame:
    """The k nearest rows after the cells that the distances in ``near`` do not exclude."""
    bounds = near.groupBy("qid").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n")).select(
        F.col("qid").alias("of"), F.when(F.col("n") >= model.k, F.col("far")).otherwise(float("inf")).alias("bound"))
    bounded = queries.join(bounds, F.col("qid") == F.col("of")).select("qid", "vec", "bound")
    return _best(near.unionByName(_candidates(model, bounded, True)), model.k)


def knn_predict(model: KNNFitted, df: DataFrame) -> DataFrame:
    """``df`` with the mean of its k nearest rows, or their most frequent class (ties to the smaller); distance ties by row id."""
    k = model.k
    rows = written(df.withColumn("__qid", F.monotonically_increasing_id()), "knn_queries")
    queries = rows.select(F.col("__qid").alias("qid"), vector(rows, model.features).alias("vec")).where(WHOLE)
    top = _best(_candidates(model, queries, False), k).drop("place")
    if len(model.pivots) > 1:
        top = _second(model, queries, written(top, "knn_first"))
    if model.task == "regression":
        found = top.groupBy("qid").agg(F.avg(F.col("y").cast("double")).alias("prediction"))
    else:
        votes = top.groupBy("qid", "y").agg(F.count(F.lit(1)).alias("votes"))
        found = votes.groupBy("qid").agg(F.min(F.struct((-F.col("votes")).alias("less"), "y")).alias("best")).select("qid", F.col("best.y").alias("prediction"))
    return rows.join(found, F.col("__qid") == F.col("qid"), "left").drop("__qid", "qid")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
