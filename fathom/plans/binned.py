"""The shared table that tree learners read: binned rows, packed into blocks.

Every feature is cut at most ``MOST`` times: between all neighbouring values of
a column of few values, else at exact quantiles; nulls and NaN have a bin of
their own. Rows without a row key are counted by their bins and target first,
so a combination that holds a third of the table is one cell with a count and
no task gets more than its share; with a key every row is a cell. A cell
carries 62 bits of md5 of its key or content, from which all random draws
follow, so a fit depends neither on cores nor on how the input is laid out.

Blocks of cells are written once to the shared folder; the passes of a learner
read them as packed binary columns.
"""

from __future__ import annotations

import hashlib
import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fathom.bundle import quote
from fathom.operators.quantiles import order_statistics_of
from fathom.session import written

#: Most cuts of a feature; the bin of missing values; bins of a histogram.
MOST, MISSING, BINS = 254, 255, 256
#: Cells of a block, and cells of a task at most.
BLOCK, TASK = 1 << 14, 1 << 20
#: Modulus of the draws (a prime below 2^31).
PRIME = 2 ** 31 - 1

BLOCKS = "block bigint, n int, bins binary, y binary, c binary, fold binary, id1 binary, id2 binary"


def feature(c: str) -> Column:
    return F.col(quote(c)).cast("double")


# ------------------------------------------------------------------ cuts
def _few_values(d: int, most: int):
    """Columns of doubles -> (col, x): the task's values of each column, or null once if they are more than ``most``."""
    def work(batches):
        seen: list = [set() for _ in range(d)]
        for b in batches:
            for i in range(d):
                if seen[i] is not None:
                    x = _doubles(b.column(i))
                    seen[i].update((np.unique(x[~np.isnan(x)]) + 0.0).tolist())
                    if len(seen[i]) > most:
                        seen[i] = None
        rows = [(i, x) for i in range(d) for x in (seen[i] if seen[i] is not None else [None])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())], names=["col", "x"])
    return work


def few_values(rows: DataFrame, cols: list[str], most: int) -> dict[str, list[float]]:
    """The values of the columns that have at most ``most``."""
    found = rows.select(*cols).mapInArrow(_few_values(len(cols), most), "col int, x double").distinct()
    found = written(found, "values")
    few = found.groupBy("col").agg(F.count("x").alias("n"), F.max(F.col("x").isNull()).alias("more")).where(f"n <= {most} and not more").select("col")
    values: dict[str, list[float]] = {c: [] for c in cols}
    for r in found.join(F.broadcast(few), "col").collect():                # ``most`` values of a column at most
        values[cols[r.col]].append(r.x)
    kept = {r.col for r in few.collect()}
    seen = {r.col for r in found.select("col").distinct().collect()}       # a column without values has no row
    return {c: v for i, (c, v) in enumerate(values.items()) if i in kept or i not in seen}


def cuts_of(rows: DataFrame, cols: list[str], most: int = MOST) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each column its ascending cuts (x <= cut goes left), and a value that stands for each bin."""
    if not cols:
        return [], []
    values = few_values(rows, cols, most + 1)
    cuts, stands = {}, {}
    many = []
    for c in cols:
        if c in values:
            own = np.array(sorted(values[c]))
            with np.errstate(all="ignore"):
                middle = own[:-1] + (own[1:] - own[:-1]) / 2
            cuts[c] = np.where((middle >= own[:-1]) & (middle < own[1:]), middle, own[:-1])
            stands[c] = own
        else:
            many.append(c)
    if many:
        n = rows.agg(*[F.sum((F.col(c).isNotNull() & ~F.isnan(c)).cast("bigint")).alias(c) for c in many]).first()
        found = order_statistics_of(rows, {c: sorted({*(math.ceil((k + 1) * n[c] / (most + 1)) - 1 for k in range(most)), n[c] - 1}) for c in many})
        for c in many:
            own = np.unique(np.array(list(found[c].values())))
            cuts[c], stands[c] = own[:-1][:most], own
    return [cuts[c] for c in cols], [stands[c] for c in cols]


def bin_matrix(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """(features, rows) of bins."""
    out = np.empty((len(cuts), len(columns[0]) if columns else 0), np.uint8)
    for i, (x, cut) in enumerate(zip(columns, cuts)):
        out[i] = np.searchsorted(cut, x, side="left")
        out[i][np.isnan(x)] = MISSING
    return out


def _doubles(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _bytes_column(rows: np.ndarray):
    """Rows of a matrix of bytes as a binary column."""
    n, width = rows.shape
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def binned_column(cuts: list[np.ndarray]):
    """Pandas UDF body: columns of doubles -> their bins, a byte each."""
    import pandas as pd

    def work(*columns):
        m = bin_matrix([c.to_numpy(np.float64, na_value=np.nan) for c in columns], cuts).T
        return pd.Series([r.tobytes() for r in np.ascontiguousarray(m)])
    return work


# ------------------------------------------------------------------ cells and blocks
def _bin_rows(cuts: list[np.ndarray]):
    """(x0.., y, fold, h) -> (bins, y, fold, h)."""
    d = len(cuts)

    def work(batches):
        for b in batches:
            m = bin_matrix([_doubles(b.column(i)) for i in range(d)], cuts).T if d else np.zeros((b.num_rows, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([_bytes_column(m), *(b.column(d + k) for k in range(3))], names=["bins", "y", "fold", "h"])
    return work


def _pack(d: int):
    """Cells -> blocks."""
    def work(batches):
        held, size = [], 0

        def close(rows):
            t = pa.Table.from_batches(rows).combine_chunks()
            n = t.num_rows
            m = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(n, d)
            h = [t.column(f"h{k}").to_numpy().astype(np.int64) for k in (1, 2)]
            block = int(((np.bitwise_xor.reduce(h[0]) << 31) ^ np.bitwise_xor.reduce(h[1])) & ((1 << 62) - 1))
            cols = [np.ascontiguousarray(m.T), t.column("y").to_numpy().astype(np.float64), t.column("c").to_numpy().astype(np.int64),
                    t.column("fold").to_numpy().astype(np.int8), *h]
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cols)],
                                              names=[x.split()[0] for x in BLOCKS.split(", ")])
        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, BLOCK - size))
                size += held[-1].num_rows
                at += held[-1].num_rows
                if size == BLOCK:
                    yield close(held)
                    held, size = [], 0
        if size:
            yield close(held)
    return work


def pack_cells(cells: DataFrame, d: int, n: int) -> DataFrame:
    """Blocks of cells ``bins, y, fold, c, h`` (n of them at most), dealt evenly by their md5 ``h`` and in one order into tasks
    whose number follows n."""
    dealt = cells.select("bins", "y", "fold", "c", *_hash_halves(F.col("h"))) \
        .repartition(max(8, math.ceil(n / TASK)), "h1", "h2").sortWithinPartitions("h1", "h2", "fold", "y")
    return written(dealt.mapInArrow(_pack(d), BLOCKS), "tree_blocks")


@dataclass
class Block:
    """A block of cells in a task."""
    block: int
    n: int
    bins: np.ndarray        # (features, n)
    y: np.ndarray
    c: np.ndarray           # rows of each cell
    fold: np.ndarray
    id1: np.ndarray
    id2: np.ndarray
    f: bytes | None = None  # scores so far (boosting)


def blocks_in(batches, d: int):
    """The blocks of Arrow batches with the columns of BLOCKS."""
    for b in batches:
        for r in b.to_pylist():
            n = r["n"]
            yield Block(r["block"], n, np.frombuffer(r["bins"], np.uint8).reshape(d, n), np.frombuffer(r["y"]), np.frombuffer(r["c"], np.int64),
                        np.frombuffer(r["fold"], np.int8), np.frombuffer(r["id1"], np.int64), np.frombuffer(r["id2"], np.int64), r.get("f"))


@dataclass
class Binned:
    features: list
    cuts: list
    stands: list
    blocks: DataFrame
    n_rows: int
    mean: float             # of the target (regression)
    classes: list | None
    label_type: object


def _hash_halves(h: Column) -> list[Column]:
    return [F.conv(F.substring(h, at, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(PRIME)).alias(f"h{k}") for k, at in ((1, 1), (2, 9))]


def prepare(df: DataFrame, features: list[str], target: str, task: str, key: list[str] | None = None,
            fold: str | None = None, most: int = MOST) -> Binned:
    """The binned blocks of the rows of ``df`` with a target; ``fold`` names a column of small numbers."""
    from fathom.functions.hashing import key_text
    classes = None
    label = feature(target)
    rows = df.where(F.col(quote(target)).isNotNull())
    if task == "classification":
        classes = sorted(r[0] for r in rows.select(quote(target)).distinct().collect())       # one row for each class
        at = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))]) if classes else None
        label = at[F.col(quote(target))] if classes else F.lit(None).cast("double")
    h = F.md5(key_text([F.col(quote(c)) for c in key]).cast("binary")) if key else F.lit(None).cast("string")
    d = len(features)
    rows = written(rows.select(*[feature(c).alias(f"x{i}") for i, c in enumerate(features)], label.alias("y"),
                               (F.col(quote(fold)) if fold else F.lit(0)).cast("int").alias("fold"), h.alias("h"))
                   .where("y is not null and not isnan(y)"), "tree_rows")
    cuts, stands = cuts_of(rows, [f"x{i}" for i in range(d)], most)
    cells = rows.mapInArrow(_bin_rows(cuts), "bins binary, y double, fold int, h string")
    if key:
        cells = cells.withColumn("c", F.lit(1).cast("bigint"))
    else:
        cells = cells.groupBy("bins", "y", "fold").agg(F.count(F.lit(1)).alias("c")) \
            .withColumn("h", F.md5(F.concat(F.col("bins"), F.col("y").cast("string").cast("binary"))))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).first()
    blocks = pack_cells(cells, d, total.n)
    return Binned(list(features), cuts, stands, blocks, int(total.n), float(total.m or 0.0), classes, df.schema[target].dataType)


# ------------------------------------------------------------------ draws
def constants(tree: int, seed: int) -> tuple[int, int, int]:
    """Three numbers below PRIME for a tree's draws, from md5."""
    h = hashlib.md5(f"{tree}|{seed}".encode()).hexdigest()
    return tuple(1 + int(h[at:at + 8], 16) % (PRIME - 1) for at in (0, 8, 16))


def draw(id1: np.ndarray, id2: np.ndarray, abc: tuple[int, int, int]) -> np.ndarray:
    """Uniform numbers below PRIME, one for each cell."""
    a, b, c = abc
    return (id1 % PRIME * a + id2 % PRIME * b % PRIME + c) % PRIME


def poisson_steps(mean: int) -> np.ndarray:
    """Numbers below PRIME at which a Poisson count of the mean goes up by one, from some count on that is never undercut."""
    top = int(mean + 12 * math.sqrt(mean) + 12)
    k = np.arange(top + 1)
    log_p = k * math.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 1)))))
    return np.floor(np.cumsum(np.exp(log_p)) * PRIME).astype(np.int64)


#: Beyond this many rows of a cell its Poisson count is drawn from the normal distribution.
NORMAL = 10_000
_steps: dict[int, np.ndarray] = {}


def bootstrap(block: Block, abc: tuple[int, int, int]) -> np.ndarray:
    """How often each cell's rows are in a tree's sample: Poisson draws, the distributed form of drawing n of n with replacement."""
    u = draw(block.id1, block.id2, abc)
    out = np.zeros(block.n, np.int64)
    for c in np.unique(block.c).tolist():
        own = block.c == c
        if c <= NORMAL:
            if c not in _steps:
                _steps[c] = poisson_steps(c)
            out[own] = np.searchsorted(_steps[c], u[own], side="right")
        else:
            from statistics import NormalDist
            z = np.array([NormalDist().inv_cdf((x + 0.5) / PRIME) for x in u[own].tolist()])
            out[own] = np.maximum(0, np.rint(c + math.sqrt(c) * z))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
