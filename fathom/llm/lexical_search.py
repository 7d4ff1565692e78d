"""Ranked lexical search, reversed: the documents are streamed through an index of the items.

The items' terms make an inverted index (term to items) that every task holds.
A first pass over the texts counts, for each document, its terms and the
occurrences of index terms, as packed postings that are written once; the
number of documents, of all terms, and of documents with each index term
are summed from them. A second pass streams the postings through the index: a
document's contribution of a term is added to every item that holds the term,
and each task keeps a heap of the ``k`` best documents of each item. The heaps
are merged in two steps, by item and a share of the tasks, then by item.

The index is bounded: items are dealt into blocks of ``BLOCK`` (item, term)
pairs by hash, as many as the measured number of pairs asks for, and each block
has its passes over all documents. What a task holds beside it are the scores
of ``CELLS`` (item, document) pairs and its heaps. Documents with many hits are
worked on fewer at a time; a long text is cut into terms in slices.

Terms are runs of letters and digits of ASCII and of all other characters from
U+0080 on; only A-Z are lower-cased. A term in df of N documents weighs
``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document of n terms, when all
documents have L, adds ``w (10^9 tf div (1000 tf + 8 m))`` for its tf
occurrences, with ``m = 10 + 90 n N div L``. All in 64-bit integers.

Defined cases: null and empty texts have no terms, do not count in N and are
never found; an item without terms finds nothing; items that repeat id and text
are one, the same id with another text is an item of its own; each row of the
documents is a document, also where ids repeat; equal scores rank by ascending
id, null ids last; extra columns are left behind; without documents or items
the result is empty.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import documents, ship, table, written

BEST = 10
#: (item, term) pairs of a block of items, on average.
BLOCK = 1 << 20
#: (item, document) scores, and index entries to add to them, that a task works on at once.
CELLS = 1 << 20
#: Bytes of a text that are cut into terms at once, and term occurrences and documents of a row of postings.
SLICE, OCCURRENCES, DOCS = 1 << 20, 1 << 18, 1 << 11
#: Salts of the first merge.
SHARES = 64

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes to lower case, and those that separate terms to blanks.
FOLD = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

PACKED = "doc binary, unknown binary, n binary, hits binary, term binary, tf binary"


def terms(text: Column) -> Column:
    """The terms of a text, with repeats."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame) -> DataFrame:
    """``item, th, term`` of the distinct terms of each item; ``items`` is (item, text)."""
    return items.select("item", F.xxhash64("text").alias("th"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()


def _slices(data: bytes):
    """Stretches of folded bytes that end at a separator."""
    start = 0
    while len(data) - start > SLICE and (end := data.find(b" ", start + SLICE)) >= 0:
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


class _Postings:
    """Term counts of some documents, packed into one row when there are enough."""

    def __init__(self, width: int):
        self.width, self.doc, self.unknown, self.n = width, [], [], []
        self.key, self.count, self.held = [], [], 0

    def add(self, doc, n: int, found: list[np.ndarray]):
        row = len(self.doc)
        self.doc.append(doc or 0)
        self.unknown.append(doc is None)
        self.n.append(n)
        for f in found:
            self.key.append(f.astype(np.int64) + row * self.width)
            self.count.append(np.ones(len(f), np.int64))
            self.held += len(f)
        return self.held >= OCCURRENCES or len(self.doc) >= DOCS

    def row(self) -> dict:
        empty = [np.zeros(0, np.int64)]
        key, count = _summed(np.concatenate(self.key or empty), np.concatenate(self.count or empty))
        hits = np.bincount(key // self.width, minlength=len(self.doc))
        some = hits > 0
        n = np.array(self.n, np.int64)
        packed = (np.array(self.doc, np.int64)[some], np.array(self.unknown, bool)[some], n[some], hits[some].astype(np.int32),
                  (key % self.width).astype(np.int32), count)
        return dict(zip(("doc", "unknown", "n", "hits", "term", "tf"), (x.tobytes() for x in packed))) | {
            "docs": int((n > 0).sum()), "terms": int(n.sum())}


def _count(vocabulary: list[bytes]):
    """(doc, text as bytes) -> rows of packed postings with their number of documents that have terms, and of terms."""
    def work(batches):
        number = {t: i for i, t in enumerate(vocabulary)}
        held = _Postings(len(vocabulary))

        def out(rows):
            return pa.RecordBatch.from_pylist([rows.row()], schema=pa.schema(
                [(x.split()[0], pa.binary()) for x in PACKED.split(", ")] + [("docs", pa.int64()), ("terms", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 128):
                for doc, text in zip(b.column(0).slice(at, 128).to_pylist(), b.column(1).slice(at, 128).to_pylist()):
                    n, found = 0, []
                    for part in _slices(text.translate(FOLD)):
                        own = part.split()
                        n += len(own)
                        of = np.fromiter(map(number.get, own, repeat(-1)), np.int32, len(own))
                        found.append(of[of >= 0])
                    if held.add(doc, n, found):
                        yield out(held)
                        held = _Postings(len(vocabulary))
        if held.doc:
            yield out(held)
    return work


def _frequencies(width: int):
    """Packed postings -> (term, documents of the task that hold it)."""
    def work(batches):
        df = np.zeros(width, np.int64)
        for b in batches:
            for term in b.column(0).to_pylist():
                df += np.bincount(np.frombuffer(term, np.int32), minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])
    return work


class _Heaps:
    """The best ``k`` documents of each item, sorted by item."""

    def __init__(self, k: int, n_items: int):
        self.k, self.least = k, np.ones(n_items, np.int64)       # the least score that can enter
        self.item, self.score, self.doc, self.unknown = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def offer(self, scores: np.ndarray, doc: np.ndarray, unknown: np.ndarray):
        """``scores``: a row for each item, a column for each document."""
        i, d = np.nonzero(scores >= self.least[:, None])
        if not len(i):
            return
        item = np.concatenate((self.item, i))
        score = np.concatenate((self.score, scores[i, d]))
        doc, unknown = np.concatenate((self.doc, doc[d])), np.concatenate((self.unknown, unknown[d]))
        order = np.lexsort((doc, unknown, -score, item))
        item = item[order]
        begin = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - begin[item]
        order, item = order[place < self.k], item[place < self.k]
        self.item, self.score, self.doc, self.unknown = item, score[order], doc[order], unknown[order]
        whole = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[item[whole]] = self.score[whole]


def _search(weight: np.ndarray, start: np.ndarray, items: np.ndarray, keys: list, n_docs: int, n_terms: int, k: int):
    """Packed postings -> the task's heaps. The items of term t are ``items[start[t]:start[t + 1]]``."""
    fan = np.diff(start)

    def work(batches):
        heaps = _Heaps(k, len(keys))
        for b in batches:
            for r in b.to_pylist():
                doc, unknown = np.frombuffer(r["doc"], np.int64), np.frombuffer(r["unknown"], bool)
                n, hits = np.frombuffer(r["n"], np.int64), np.frombuffer(r["hits"], np.int32)
                term, tf = np.frombuffer(r["term"], np.int32), np.frombuffer(r["tf"], np.int64)
                m = 10 + 90 * n * n_docs // n_terms
                row = np.repeat(np.arange(len(doc)), hits)
                adds = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                # documents at a time, so that scores and index entries stay below CELLS
                ends = np.concatenate(([0], np.cumsum(hits)))
                load = np.maximum(np.concatenate(([0], np.cumsum(fan[term])))[ends], np.arange(len(ends)) * len(keys))
                a = 0
                while a < len(doc):
                    z = max(a + 1, int(np.searchsorted(load, load[a] + CELLS)) - 1)
                    part = slice(ends[a], ends[z])
                    reach = fan[term[part]]
                    first = np.cumsum(reach) - reach
                    entry = np.arange(reach.sum()) - np.repeat(first - start[term[part]], reach)
                    cell = items[entry] * (z - a) + np.repeat(row[part] - a, reach)
                    scores = np.zeros(len(keys) * (z - a), np.int64)
                    np.add.at(scores, cell, np.repeat(adds[part], reach))
                    heaps.offer(scores.reshape(len(keys), z - a), doc[a:z], unknown[a:z])
                    a = z
        known = [keys[i] for i in heaps.item.tolist()]
        yield pa.RecordBatch.from_arrays([
            pa.array([x for x, _ in known], pa.int64()), pa.array([x for _, x in known], pa.int64()),
            pa.array(heaps.doc, pa.int64(), mask=heaps.unknown), pa.array(heaps.score)], names=["item", "th", "doc", "score"])
    return work


def _block(texts: DataFrame, pairs: list, k: int) -> DataFrame:
    """``item, th, doc, score, task``: the heaps of all tasks for one block of items."""
    keys = sorted({(r.item, r.th) for r in pairs}, key=lambda x: (x[0] is None, x))
    vocabulary = sorted({r.term.encode() for r in pairs})
    number, of_term = {x: i for i, x in enumerate(keys)}, {t: i for i, t in enumerate(vocabulary)}
    index = np.array(sorted((of_term[r.term.encode()], number[r.item, r.th]) for r in pairs), np.int64)
    start = np.searchsorted(index[:, 0], np.arange(len(vocabulary) + 1))
    postings = written(texts.mapInArrow(_count(vocabulary), f"{PACKED}, docs bigint, terms bigint"), "postings")
    total = postings.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    seen = postings.select("term").mapInArrow(_frequencies(len(vocabulary)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(len(vocabulary), np.int64)
    for r in seen.collect():                                    # a row for each term of the block at most
        weight[r.term] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r.df + 1)))
    find = _search(weight, start, index[:, 1], keys, total.docs or 0, max(1, total.terms or 0), k)
    return postings.drop("docs", "terms").mapInArrow(find, "item bigint, th bigint, doc bigint, score bigint") \
        .withColumn("task", F.pmod(F.spark_partition_id(), F.lit(SHARES)))


def search(df: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", block: int = BLOCK) -> DataFrame:
    """``item, th, rank, doc, score``: the ``k`` best documents of each item; ``th`` is the hash of the item's text."""
    texts = documents(df, id_col, text_col).select("doc", F.col("text").cast("binary").alias("text"))
    pairs = written(item_terms(documents(items, item_col).withColumnRenamed("doc", "item")), "item_terms")
    blocks = max(1, math.ceil(pairs.count() / block))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item", "th"), F.lit(blocks)))
    heaps = pairs.select("item", "th", F.lit(0).cast("bigint").alias("doc"), F.lit(0).cast("bigint").alias("score"), F.lit(0).alias("task")).limit(0)
    for b in range(blocks):
        if own := dealt.where(F.col("block") == b).collect():   # about ``block`` rows
            heaps = heaps.unionByName(_block(texts, own, k))
    best = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    for by in (["item", "th", "task"], ["item", "th"]):
        heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
    return heaps.select("item", "th", "rank", "doc", "score")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM lengths),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@register("op11_lexical_search", SQL)
def op11_lexical_search(spark, sf_dir):
    """The ten best documents of each benchmark item."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


ship(__name__)
