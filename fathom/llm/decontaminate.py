"""Benchmark decontamination by spaced-seed hashing (native).

A seed is a fixed mask over ``SPAN`` consecutive words: the hash of the words
at its care positions ignores the others, so a substituted word breaks only
the seeds that care about its place. Seeds of the training texts are joined
to seeds of the benchmark on their hash; around each hit the two texts are
laid on each other without gaps, and an overlap counts when some ``window``
words around the hit (the whole item when it is shorter) agree in at least
``agree`` of their places.

A training text's seeds are tested in its own row against a bitmap of the
benchmark's seed hashes, a filter of a stated size without false negatives,
so only hits of the bitmap are exploded and shuffled. The bitmap has 32 bits a
benchmark seed, up to ``BITMAP_BITS``; a larger benchmark only lets more
non-hits through to the join, which is exact.

An item shorter than ``window`` words has masks over all its words: they are
cut into parts, and each mask leaves out as many parts as ``agree`` allows
substitutions, so one of them stays whole wherever these are (items of up to
four words allow none by default).

Defined cases: a null or empty text has no words and no hits; items without words match nothing; repeated items and documents
count as one; a null document id is a document of its own; extra columns are
left behind.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import documents, table, words

#: Care positions of the masks: wherever two words of a window of 13 are substituted, a seed of it stays whole.
MASKS = [[0, 1, 2, 4, 7, 9], [0, 3, 4, 5, 8, 9]]
SPAN = 10
WINDOW, AGREE = 13, 0.8
#: Most bits of the bitmap (512 KB as longs).
BITMAP_BITS = 1 << 22


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _positions(n: Column) -> Column:
    """0 .. n - 1, none for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _seed(w: Column, i: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(w, i + j) for j in MASKS[mask]))


def short_masks(n: int, agree: float = AGREE) -> list[list[int]]:
    """Care positions for items of n words, of which any ``n - ceil(n * agree)`` may be substituted."""
    subs = n - math.ceil(n * agree)
    parts = max(subs + 1, min(n, subs + 2)) if subs else 1
    cut = [range(n * j // parts, n * (j + 1) // parts) for j in range(parts)]
    return [[p for j, part in enumerate(cut) if j not in gone for p in part] for gone in itertools.combinations(range(parts), subs)]


def _short(w: Column, i: Column, n: int, mask: int, agree: float) -> Column:
    return F.xxhash64(F.lit(1000 * n + mask), *(F.get(w, i + j) for j in short_masks(n, agree)[mask]))


def _tests(w: Column, short: list[int], agree: float = AGREE) -> list:
    """(length, first and last care position, hash at i) of each kind of seed: the masks, and those of shorter items."""
    return [(SPAN, MASKS[m][0], MASKS[m][-1], lambda i, m=m: _seed(w, i, m)) for m in range(len(MASKS))] + \
        [(n, mask[0], mask[-1], lambda i, n=n, m=m: _short(w, i, n, m, agree)) for n in short for m, mask in enumerate(short_masks(n, agree))]


def item_seeds(items: DataFrame, short: list[int], agree: float = AGREE) -> DataFrame:
    """``item, seed, at, iw`` of every seed of the items (``item``, ``iw``: hashed words)."""
    w, n = F.col("iw"), F.size("iw")

    def masked(m):
        return F.transform(_positions(n - SPAN + 1), lambda i: F.struct(_seed(w, i, m).alias("seed"), i.alias("at")))
    masks = [masked(m) for m in range(len(MASKS))]
    whole = [F.when(n == k, F.array(*(F.struct(_short(w, F.lit(0), k, m, agree).alias("seed"), F.lit(0).alias("at"))
                                      for m in range(len(short_masks(k, agree))))))
             .otherwise(F.expr("cast(array() as array<struct<seed:bigint,at:int>>)")) for k in short]
    return items.select("item", "iw", F.explode(F.concat(*masks, *whole)).alias("s")).select("item", "iw", "s.seed", "s.at")


def _bitmap(seeds: DataFrame) -> tuple[Column, int]:
    """A constant array of longs with a bit set for each seed, and its number of bits."""
    n = seeds.count()
    bits = min(BITMAP_BITS, max(1 << 10, 1 << (32 * n).bit_length()))
    at = F.shiftright(F.col("seed").bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    found = seeds.select(at.alias("k"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("b")) \
        .groupBy("k").agg(F.bit_or("b").alias("b")).collect()
    longs = {r.k: r.b for r in found}
    return F.split(F.lit(",".join(str(longs.get(k, 0)) for k in range(bits >> 6))), ",").cast("array<bigint>"), bits


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """``doc, th, item, start, agreeing, length``: the best aligned window of each document and item.

    ``docs`` is (doc, text), ``items`` (item, text); ``start`` is the word of the document where the window begins,
    ``th`` the hash of the document's text."""
    hashed = F.transform(words(F.col("text")), lambda x: F.xxhash64(x))
    bench = items.select("item", hashed.alias("iw")).where("size(iw) > 0")
    short = sorted(r.n for r in bench.select(F.size("iw").alias("n")).where(F.col("n") < window).distinct().collect())
    seeds = item_seeds(bench, short, agree)
    bitmap, bits = _bitmap(seeds.select("seed").distinct())

    def inside(h, longs, n):
        word = F.get(longs, F.shiftright(h.bitwiseAND(F.lit(n - 1)), 6).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    # a word that no item has cannot begin or end a seed
    vocabulary, vbits = _bitmap(bench.select(F.explode("iw").alias("seed")).distinct())

    def hits(w):
        def near(i):
            return F.slice(w, F.greatest(i - window + 2, F.lit(1)), 2 * window + SPAN)

        def of(in_items, n, head, tail, seed):
            kept = F.filter(_positions(F.size(w) - n + 1), lambda i: (
                F.get(in_items, i + head) & F.get(in_items, i + tail) & inside(seed(i), bitmap, bits)))
            return F.transform(kept, lambda i: F.struct(seed(i).alias("seed"), i.alias("at"), near(i).alias("near"),
                                                        F.least(i, F.lit(window - 1)).alias("shift")))
        return _let(F.transform(w, lambda h: inside(h, vocabulary, vbits)),
                    lambda in_items: F.concat(*(of(in_items, *t) for t in _tests(w, short, agree))))
    found = docs.select("doc", F.xxhash64("text").alias("th"), F.explode(_let(hashed, hits)).alias("s")) \
        .select("doc", "th", "s.seed", F.col("s.at").alias("pos"), "s.near", "s.shift")
    joined = found.join(seeds, "seed")
    # the document's word for place p of the item is near[p - at + shift]
    size, at, shift = F.size("iw"), F.col("at"), F.col("shift")
    same = F.transform(F.sequence(-F.least(at, shift), F.least(size - at, F.size("near") - shift) - 1),
                       lambda o: (F.get("iw", at + o) == F.get("near", shift + o)).cast("int"))
    need = F.least(F.lit(window), size)

    def best(s):
        first = F.slice(s, F.lit(1), need)
        start = F.struct(F.lit(0).alias("k"), F.aggregate(first, F.lit(0), lambda a, x: a + x).alias("sum"))
        every = F.aggregate(_positions(F.size(s) - need), F.struct(start["sum"].alias("sum"), start["sum"].alias("top"), F.lit(0).alias("from")),
                            lambda a, k: _slide(a, k, s, need))
        return F.when(F.size(s) >= need, F.struct(every["top"].alias("agreeing"), every["from"].alias("from")))
    scored = joined.select("doc", "th", "item", (F.col("pos") - F.least(at, shift)).alias("left"), need.alias("length"),
                           _let(same, best).alias("b")) \
        .where(F.col("b.agreeing") >= F.ceil(F.col("length") * agree))
    top = F.struct(F.col("b.agreeing").alias("agreeing"), (-(F.col("left") + F.col("b.from"))).alias("minus"), F.col("length").alias("length"))
    return scored.groupBy("doc", "th", "item").agg(F.max(top).alias("t")).select(
        "doc", "th", "item", (-F.col("t.minus")).alias("start"), "t.agreeing", "t.length")


def _slide(a: Column, k: Column, s: Column, need: Column) -> Column:
    """The window of ``need`` places moves from k to k + 1."""
    now = a["sum"] - F.get(s, k) + F.get(s, k + need)
    return F.struct(now.alias("sum"), F.greatest(a["top"], now).alias("top"), F.when(now > a["top"], k + 1).otherwise(a["from"]).alias("from"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """``doc, th, n_items, items, agreeing``: the documents with an overlap, their items in order and the best agreement."""
    return overlaps(docs, items, window, agree).groupBy("doc", "th").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"),
        F.max(F.col("agreeing") / F.col("length")).alias("agreement"))


def without_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that do not overlap an item."""
    least = F.lit(-(2 ** 63))
    bad = overlaps(documents(df, id_col, text_col), items).select(F.coalesce("doc", least).alias("__doc"), F.col("th").alias("__th")).distinct()
    rows = df.withColumn("__doc", F.coalesce(F.col(f"`{id_col}`").cast("bigint"), least)) \
        .withColumn("__th", F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    return rows.join(bad, ["__doc", "__th"], "left_anti").drop("__doc", "__th")


def benchmark_items(spark, sf_dir) -> DataFrame:
    return documents(table(spark, sf_dir, "benchmark"), "item_id").select(F.col("doc").alias("item"), "text")


SQL = r"""
WITH dt AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
bt AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(len(w)))::INT AS pos FROM dt),
bp AS (SELECT item_id, w, unnest(range(len(w)))::INT AS ip FROM bt),
hits AS (
  SELECT doc_id, item_id, d.w AS dw, b.w AS bw, pos, ip FROM dp d JOIN bp b ON len(d.w) - pos >= 10 AND len(b.w) - ip >= 10 AND (
    d.w[pos+1] || ' ' || d.w[pos+2] || ' ' || d.w[pos+3] || ' ' || d.w[pos+5] || ' ' || d.w[pos+8] || ' ' || d.w[pos+10]
    = b.w[ip+1] || ' ' || b.w[ip+2] || ' ' || b.w[ip+3] || ' ' || b.w[ip+5] || ' ' || b.w[ip+8] || ' ' || b.w[ip+10])
  UNION ALL
  SELECT doc_id, item_id, d.w, b.w, pos, ip FROM dp d JOIN bp b ON len(d.w) - pos >= 10 AND len(b.w) - ip >= 10 AND (
    d.w[pos+1] || ' ' || d.w[pos+4] || ' ' || d.w[pos+5] || ' ' || d.w[pos+6] || ' ' || d.w[pos+9] || ' ' || d.w[pos+10]
    = b.w[ip+1] || ' ' || b.w[ip+4] || ' ' || b.w[ip+5] || ' ' || b.w[ip+6] || ' ' || b.w[ip+9] || ' ' || b.w[ip+10])
  UNION ALL
  SELECT doc_id, item_id, d.w, b.w, pos, ip FROM dp d JOIN (SELECT item_id, w, 0 AS ip FROM bt WHERE len(w) BETWEEN 1 AND 9) b
    ON d.w[pos+1:pos+len(b.w)] = b.w),
around AS (
  SELECT *, least(ip, least(pos, 12)) AS back, least(len(bw) - ip, least(36, len(dw) - greatest(pos - 12, 0)) - least(pos, 12)) AS ahead,
    least(13, len(bw)) AS need FROM hits),
windows AS (
  SELECT doc_id, item_id, need, pos - back + k AS start,
    list_sum(list_transform(range(need), lambda j: (dw[pos - back + k + j + 1] = bw[ip - back + k + j + 1])::INT))::INT AS agreeing
  FROM (SELECT *, unnest(range(0, greatest(back + ahead - need + 1, 0)))::INT AS k FROM around))
SELECT doc_id, item_id, arg_min(start, [-agreeing, start])::INT AS start, max(agreeing) AS agreeing, max(need)::INT AS length
FROM windows WHERE agreeing >= ceil(need * 0.8::DOUBLE) GROUP BY doc_id, item_id
"""


@register("op5_benchmark_decontamination", SQL)
def op5_benchmark_decontamination(spark, sf_dir):
    """Every document that overlaps a benchmark item, with the item and their best aligned window."""
    found = overlaps(documents(table(spark, sf_dir, "documents")), benchmark_items(spark, sf_dir))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").cast("int").alias("start"),
                        "agreeing", "length")
