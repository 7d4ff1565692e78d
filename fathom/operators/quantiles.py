"""Exact order statistics without a global sort or a per-value map.

Spark's ``percentile`` keeps a map of every distinct value of the group in
one reducer, and ``percentile_approx`` does not interpolate. Here the k-th
smallest value is found by radix refinement over the order-preserving 64-bit
image of a double: read as a signed integer, a positive double's bits already
sort like the double, a negative one's do with the bits below the sign
flipped. Infinities are ordinary keys and heavy tails cost nothing.

A pass counts, for all columns in one job, the values whose leading bits are
those of a bucket that holds a wanted rank, by their next ``bits`` bits. Tasks
sort and count their own values, so one row for each of their buckets is
shuffled; a windowed sum inside each bucket finds the ranks, and one row for
each rank reaches the driver. With 16 bits four passes end in the value; a
bucket of one value (a hot one) ends at once, and a few buckets that hold at most
``collect_limit`` values together are read and ranked directly.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

BITS, COLLECT_LIMIT, MOST_READ = 16, 50_000, 32
_BELOW_SIGN = np.int64(2 ** 63 - 1)


def image(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles x; zeros are equal."""
    b = (x + 0.0).view(np.int64)
    return b ^ ((b >> np.int64(63)) & _BELOW_SIGN)


def preimage(key: int) -> float:
    b = np.array([key], np.int64)
    return float((b ^ ((b >> np.int64(63)) & _BELOW_SIGN)).view(np.float64)[0])


def _grouped(code: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Rows of equal code as one: summed counts, least low, greatest high."""
    order = np.argsort(code, kind="stable")
    code, n, low, high = code[order], n[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _count(shift: int, bits: int, wanted: list[np.ndarray | None]):
    """Columns of doubles -> (col, code, n, low, high): the task's values by their leading bits ``key >> shift``.

    ``wanted`` has the sorted codes of the pass before that hold a rank (None: all; an empty array: the column is done)."""
    def work(batches):
        held: list[list] = [[] for _ in wanted]
        size = 0

        def rows():
            for i, parts in enumerate(held):
                if parts:
                    code, n, low, high = _grouped(*map(np.concatenate, zip(*parts)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i, np.int32)), *map(pa.array, (code, n, low, high))],
                                                     names=["col", "code", "n", "low", "high"])
        for b in batches:
            for i, of in enumerate(wanted):
                if of is not None and not len(of):
                    continue
                x = b.column(i).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
                key = image(x[~np.isnan(x)])
                if of is not None:
                    before = key >> np.int64(shift + bits)
                    at = np.minimum(np.searchsorted(of, before), len(of) - 1)
                    key = key[of[at] == before]
                if not len(key):
                    continue
                key.sort()
                code = key >> np.int64(shift)
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                ends = np.append(first[1:], len(key))
                held[i].append((code[first], ends - first, key[first], key[ends - 1]))
                size += len(first)
            if size > 1 << 21:                          # tasks that see many buckets pass them on before the end
                yield from rows()
                held, size = [[] for _ in wanted], 0
        yield from rows()
    return work


@dataclass
class _Rank:
    col: int
    rank: int               # 0-based rank wanted
    code: int = 0           # leading bits of the bucket that holds it
    base: int = 0           # values below the bucket
    n: int = 0              # values in it, the least and the greatest as keys
    low: int = 0
    high: int = 0
    value: float | None = None


def order_statistics_of(values: DataFrame, ranks: dict[str, list[int]], bits: int = BITS,
                        collect_limit: int = COLLECT_LIMIT) -> dict[str, dict[int, float]]:
    """``{column: {rank: value}}`` for 0-based ranks over the non-null, non-NaN values of each column."""
    cols = list(ranks)
    v = values.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    targets = [_Rank(i, r) for i, c in enumerate(cols) for r in sorted(set(ranks[c]))]
    wanted: list[np.ndarray | None] = [None if ranks[c] else np.zeros(0, np.int64) for c in cols]
    shift = 64
    while pending := [t for t in targets if t.value is None]:
        step = min(bits, shift)
        shift -= step
        _locate(v, pending, shift, step, wanted)
        for t in pending:
            if t.low == t.high:
                t.value = preimage(t.low)
        pending = [t for t in pending if t.value is None]
        buckets = {(t.col, t.low, t.high): t.n for t in pending}
        if pending and len(buckets) <= MOST_READ and sum(buckets.values()) <= collect_limit:
            _read(v, pending, list(buckets))
        wanted = [np.array(sorted({t.code for t in pending if t.col == i}), np.int64) for i in range(len(cols))]
    return {c: {t.rank: t.value for t in targets if t.col == i} for i, c in enumerate(cols)}


def _locate(v: DataFrame, pending: list[_Rank], shift: int, bits: int, wanted: list) -> None:
    """One pass: the bucket of each rank by ``bits`` more bits."""
    counts = v.mapInArrow(_count(shift, bits, wanted), "col int, code bigint, n bigint, low bigint, high bigint") \
        .groupBy("col", "code").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = shift + bits >= 64
    within = F.lit(0).cast("bigint") if whole else F.shiftright("code", bits)
    counts = counts.withColumn("part", within)
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("col", "part").orderBy("code")))
    asked = v.sparkSession.createDataFrame(
        [(k, t.col, 0 if whole else t.code, t.rank - t.base) for k, t in enumerate(pending)], "k int, of int, of_part bigint, r bigint")
    found = counts.join(F.broadcast(asked), (F.col("col") == F.col("of")) & (F.col("part") == F.col("of_part"))
                        & (F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n")))
    rows = {r.k: r for r in found.select("k", "code", "n", "low", "high", "upto").collect()}     # one row for each rank
    for k, t in enumerate(pending):
        if t.rank < 0 or k not in rows:
            raise ValueError(f"rank {t.rank} is outside the values")
        r = rows[k]
        t.base += r.upto - r.n
        t.code, t.n, t.low, t.high = r.code, r.n, r.low, r.high


def _read(v: DataFrame, pending: list[_Rank], buckets: list[tuple[int, int, int]]) -> None:
    """The values of small buckets, ranked here."""
    inside = [F.when(F.col(f"x{i}").between(preimage(low), preimage(high)) & ~F.isnan(f"x{i}"), F.struct(F.lit(b).alias("b"), F.col(f"x{i}").alias("x")))
              for b, (i, low, high) in enumerate(buckets)]
    found = v.select(F.explode(F.array(*inside)).alias("f")).where("f is not null").select("f.b", "f.x").collect()
    of = {key: sorted(r.x for r in found if r.b == b) for b, key in enumerate(buckets)}
    for t in pending:
        t.value = of[t.col, t.low, t.high][t.rank - t.base] + 0.0


def order_statistics(values: DataFrame, col: str, ranks: list[int], *, bins: int = 1 << BITS,
                     collect_limit: int = COLLECT_LIMIT) -> dict[int, float]:
    """{rank: value} for 0-based ranks over the non-null, non-NaN ``col``; ``bins`` buckets a pass."""
    return order_statistics_of(values, {col: ranks}, max(1, bins.bit_length() - 1), collect_limit)[col]


def interpolated_quantiles(values: DataFrame, col: str, probs: list[float], n: int | None = None, **kw) -> dict[float, float | None]:
    """Linear-interpolated quantiles (pandas/numpy default, DuckDB quantile_cont); ``n`` is the number of values, if known."""
    x = F.col(f"`{col}`").cast("double")
    if n is None:
        n = values.where(x.isNotNull() & ~F.isnan(x)).count()
    if n == 0:
        return {p: None for p in probs}
    wanted = {k for p in probs for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
    stats = order_statistics(values, col, sorted(wanted), **kw)
    out = {}
    for p in probs:
        h = (n - 1) * p
        a, b = stats[math.floor(h)], stats[math.ceil(h)]
        # an infinity has no difference to itself
        out[p] = a if a == b or h == math.floor(h) else a + (b - a) * (h - math.floor(h))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
