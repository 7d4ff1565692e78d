"""Periodic run detection with a difference cover.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends and that is at least ``LEAST`` words and ``TIMES`` q
long. Every task works on its own documents, some at a time; nothing is shuffled.

*Grid.* The places where a word equals the word q later form a stretch of at
least ``max(LEAST, TIMES q) - q`` places in such a run. A grid of about that
step has a place in it that is followed by ``CLOSE`` equal ones, so for each q
only grid places are tried: n / q of them, n log n in all. A place whose next
``CLOSE`` words have not the hash of those q later lies in no run.

*Longest common extensions.* The other places ask how far the words from i and
from i + q agree, forwards, and backwards in the reversed text. Suffixes are
sorted only at places whose remainder by ``MODULUS`` lies in the difference
cover ``COVER``: any two places reach two of these together in fewer than
``MODULUS`` steps. Sampled suffixes are ranked by prefix doubling over blocks of
``MODULUS`` words, the blocks that neighbours in that order share are minima of
a sparse table, and what is left before the first sampled place and behind the
last common block is compared word by word. Blocks are named by hash and each
is compared to the first of its name; on a difference they are named by their words.

Periods that are multiples of the smallest give the same stretch, so the least
period of each stretch is the run's.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and
carriage return; they are numbered, so equality is exact.

Defined cases: a null or empty text has no words and no runs; each row is a
document, also where ids repeat or are null; a long text is cut into words in
slices and is worked on alone; extra columns are left behind.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import documents, ship, table
from fathom.llm.wordhash import mix

LEAST, TIMES = 24, 3
#: Any two remainders have a difference of two members of the cover.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words that are compared by hash before a longest common extension is asked for.
CLOSE = 8
#: Words of the documents that are worked on at once (one document more at most), and grid places tried at once.
WORDS, PLACES = 1 << 18, 1 << 20
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
BLANK = re.compile(rb"[ \t-\r]")

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def slices(data: bytes):
    """Stretches of a text that end at white space."""
    start = 0
    while len(data) - start > SLICE and (found := BLANK.search(data, start + SLICE)):
        yield data[start:found.start()]
        start = found.start()
    yield data[start:] if start else data


def _delta() -> np.ndarray:
    """For each difference d of two places, a member of the cover from which d leads to another."""
    reach = {(b - a) % MODULUS: a for b in COVER for a in COVER}
    return np.array([reach[d] for d in range(MODULUS)])


class Extensions:
    """Longest common extensions of a sequence of numbers (each at least 0) that ends in a number found nowhere else."""

    def __init__(self, seq: np.ndarray):
        size = -(-len(seq) // MODULUS) * MODULUS
        # behind the end: numbers of their own, so that no suffix is the start of another
        self.n = len(seq)
        self.seq = np.concatenate((seq, seq.max(initial=0) + 1 + np.arange(size - self.n + 2 * MODULUS))).astype(np.int32)
        self.reach = _delta()
        cover = len(COVER)
        self.index = np.full(MODULUS, -1)
        self.index[list(COVER)] = np.arange(cover)
        place = (np.arange(size // MODULUS)[:, None] * MODULUS + np.array(COVER)).ravel()
        ranks, step = [self._names(place)], cover
        while step < len(place) and len(ranks[-1]) and ranks[-1].max() + 1 < len(place):
            pair = ranks[-1] * np.int64(len(place) + 1)
            pair[:-step] += ranks[-1][step:] + 1
            ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
            step *= 2
        self.rank = ranks[-1]
        # blocks that neighbours in the order of ranks share
        order = np.argsort(self.rank, kind="stable")
        a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, len(order) - 1), np.int32)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < len(place)) & (b < len(place))
            same = np.zeros(len(a), bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            shared += same.astype(np.int32) << k
            a, b = a + same * (cover << k), b + same * (cover << k)
        self.least = [shared]
        while 2 << (len(self.least) - 1) <= len(shared):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _names(self, place: np.ndarray) -> np.ndarray:
        """Equal numbers for equal blocks of MODULUS words at the places."""
        code = np.zeros(len(place), np.uint64)
        for k in range(MODULUS):
            code = mix(code ^ self.seq[place + k].astype(np.uint64)) + np.uint64(k)
        _, first, name = np.unique(code, return_index=True, return_inverse=True)
        for k in range(MODULUS):
            if (self.seq[place + k] != self.seq[place[first[name]] + k]).any():
                name = np.unique(self.seq[place[:, None] + np.arange(MODULUS)], axis=0, return_inverse=True)[1].ravel()
                break
        return name.astype(np.int32)

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, ``most`` (at most MODULUS) of them counted."""
        length = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for k in range(MODULUS):
            live = live[(most[live] > k)]
            live = live[self.seq[i[live] + k] == self.seq[j[live] + k]]
            if not len(live):
                break
            length[live] += 1
        return length

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree (i < j)."""
        wait = (self.reach[(j - i) % MODULUS] - i) % MODULUS
        length = self._compare(i, j, wait)
        on = np.flatnonzero((length == wait) & (j + wait < self.n))
        a, b = i[on] + wait[on], j[on] + wait[on]
        at = lambda p: self.rank[p // MODULUS * len(COVER) + self.index[p % MODULUS]]
        ra, rb = at(a), at(b)
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(float))[1] - 1
        blocks = np.zeros(len(on), np.int64)
        for v in np.unique(level):
            here = level == v
            t = self.least[v]
            blocks[here] = np.minimum(t[low[here]], t[high[here] - (1 << v)])
        whole = blocks * MODULUS
        length[on] += whole + self._compare(a + whole, b + whole, np.full(len(on), MODULUS))
        return length


def _close(seq: np.ndarray) -> np.ndarray:
    """Hash of the CLOSE words from each place on (fewer places than words)."""
    base = mix(seq.astype(np.uint64) + np.uint64(1))
    size = max(0, len(seq) - CLOSE + 1)
    code = np.zeros(size, np.uint64)
    for k in range(CLOSE):
        code = (code ^ base[k:k + size]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def _grid(begin: np.ndarray, size: np.ndarray, least: int, times: int):
    """(place, period) of the grids of all documents, PLACES at once; documents are [begin, begin + size)."""
    top = np.minimum(size // times, size - CLOSE)
    top = np.where(size >= least, np.maximum(top, 0), 0)
    ends = np.concatenate(([0], np.cumsum(top)))
    pairs = PLACES // 4
    for lo in range(0, int(ends[-1]), pairs):
        number = np.arange(lo, min(lo + pairs, int(ends[-1])))
        doc = np.searchsorted(ends, number, side="right") - 1
        q = number - ends[doc] + 1
        step = np.maximum(np.maximum(least, times * q) - q - CLOSE + 1, 1)
        # the last place has CLOSE words left behind its partner
        count = (size[doc] - q - CLOSE) // step + 1
        total = np.concatenate(([0], np.cumsum(count)))
        a = 0
        while a < len(q):
            z = max(a + 1, int(np.searchsorted(total, total[a] + PLACES)) - 1)
            c = count[a:z]
            turn = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(begin[doc[a:z]], c) + turn * np.repeat(step[a:z], c), np.repeat(q[a:z], c)
            a = z


def _least_periods(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least period, by start and period."""
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    order = np.lexsort((q[new], start[new]))
    return start[new][order], end[new][order], q[new][order]


def find_runs(seq: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int = LEAST, times: int = TIMES):
    """``start, end, period`` of all runs, by start and period; start and end are places of ``seq``.

    ``seq`` holds the documents' word numbers, each document followed by a number found nowhere else."""
    code = _close(seq)

    def hits():
        for place, q in _grid(begin, size, least, times):
            same = np.flatnonzero(code[place] == code[place + q])
            if len(same):
                yield place[same], q[same]
    # the documents with such places; the places themselves are kept if they are few, else found anew
    used, held, n_held = np.zeros(len(begin), bool), [], 0
    for place, q in hits():
        used[np.searchsorted(begin, place, side="right") - 1] = True
        n_held += len(place)
        held = held + [(place, q)] if n_held <= PLACES else []
    found = [tuple(np.zeros((3, 0), np.int64))]
    if not used.any():
        return found[0]
    # only documents with such a place are sorted; they are laid one after another, behind a number found nowhere else
    used = np.flatnonzero(used)
    length = size[used] + 1
    at = np.concatenate(([0], np.cumsum(length)))
    shift = begin[used] - at[:-1] - 1
    part = np.concatenate(([seq.max() + 1], seq[np.arange(at[-1]) + np.repeat(shift + 1, length)])).astype(np.int32)
    forward, backward, last = Extensions(part), Extensions(part[::-1].copy()), len(part) - 1
    n_found = 0
    for place, q in held if n_held <= PLACES else hits():
        by = shift[np.searchsorted(begin[used], place, side="right") - 1]
        i = place - by
        start, end = place - backward(last - i - q + 1, last - i + 1), place + q + forward(i, i + q)
        good = end - start >= np.maximum(least, times * q)
        found.append((start[good], end[good], q[good]))
        n_found += int(good.sum())
        if n_found >= PLACES:
            found = [_least_periods(*map(np.concatenate, zip(*found)))]
            n_found = 0
    return _least_periods(*map(np.concatenate, zip(*found)))


def _kept_text(text: bytes, keep: np.ndarray) -> bytes:
    """The words to keep, one blank apart."""
    out, at = [], 0
    for part in slices(text):
        words = part.split()
        out += [w for w, k in zip(words, keep[at:at + len(words)].tolist()) if k]
        at += len(words)
    return b" ".join(out)


def _work(least: int, times: int):
    def solve(docs, texts, parts, sizes):
        size = np.array(sizes, np.int64)
        begin = np.cumsum(size + 1) - (size + 1)
        top = max((int(p.max(initial=-1)) for p in parts), default=-1) + 1
        seq = np.concatenate([x for k, p in enumerate(parts) for x in (p, np.array([top + k], np.int32))])
        start, end, q = find_runs(seq, begin, size, least, times)
        of = np.searchsorted(begin, start, side="right") - 1
        bounds = np.searchsorted(of, np.arange(len(docs) + 1))
        mark = np.zeros(len(seq) + 1, np.int64)
        np.add.at(mark, start + q, 1)
        np.add.at(mark, end, -1)
        keep = np.cumsum(mark)[:-1] == 0
        rows = []
        for k, (doc, text) in enumerate(zip(docs, texts)):
            a, z = bounds[k], bounds[k + 1]
            own = [{"start": s, "length": e - s, "period": p} for s, e, p in zip(
                (start[a:z] - begin[k]).tolist(), (end[a:z] - begin[k]).tolist(), q[a:z].tolist())]
            rows.append({"doc": doc, "n_words": sizes[k], "runs": own, "collapsed": _kept_text(text, keep[begin[k]:begin[k] + size[k]])})
        return rows

    kind = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
        [(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.binary())])

    def work(batches):
        def empty():
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__        # a new word gets the next number
            return number, [], [], [], []
        (number, docs, texts, parts, sizes), held = empty(), 0
        for b in batches:
            for at in range(0, b.num_rows, 128):
                for doc, text in zip(b.column(0).slice(at, 128).to_pylist(), b.column(1).slice(at, 128).to_pylist()):
                    own = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in (s.split() for s in slices(text))]
                    docs.append(doc)
                    texts.append(text)
                    parts.append(np.concatenate(own))
                    sizes.append(len(parts[-1]))
                    held += sizes[-1] + 1
                    if held >= WORDS:
                        number.default_factory = None           # else only the cycle collector frees it, which comes late
                        yield pa.RecordBatch.from_pylist(solve(docs, texts, parts, sizes), schema=kind)
                        (number, docs, texts, parts, sizes), held = empty(), 0
        if docs:
            yield pa.RecordBatch.from_pylist(solve(docs, texts, parts, sizes), schema=kind)
    return work


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc, n_words, runs, collapsed``: every run of each document by start and period, and the words outside all
    repetitions, one blank apart (of a run its first period stays)."""
    if times < 2 or least - 1 < CLOSE or (times - 1) * -(-least // times) < CLOSE:
        raise ValueError(f"runs of fewer than {CLOSE} repeated words are not found")
    docs = documents(df, id_col, text_col).select("doc", F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(_work(least, times), f"doc bigint, n_words bigint, runs {RUNS}, collapsed binary") \
        .withColumn("collapsed", F.col("collapsed").cast("string"))


def steepest(runs: Column) -> Column:
    """The run of greatest length / period, of equal ones the first by start, then period; compared without rounding."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: one document in ten by the CRC of its id goes on from some word with a period drawn from it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g")) \
        .withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("bigint"))).withColumn("a", F.expr("g % n")) \
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.array_join(F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Runs of every document, some of which go on with a period, and digests of the runs and of the collapsed text."""
    found = periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = F.col("best")
    return found.withColumn("best", steepest(F.col("runs"))).select(
        F.col("doc").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


ship(__name__)
