"""Document fingerprints by one-permutation MinHash (native).

Every word 5-gram of a text is hashed once. The top bits of the hash choose
one of ``BINS`` bins and the smallest remainder of a bin is its value. An
empty bin takes the value of another bin by optimal densification: it probes
the bins in an order of its own (a pseudo-random full cycle) and takes the
first non-empty one, so every non-empty bin is an equally likely donor and
empty bins choose independently. A value is hashed with its bin, so that bins
of one donor have bits of their own. The fingerprint keeps the low ``BITS`` bits
of each, packed into 64-bit words and written in hexadecimal. Two
unrelated values agree in their low bits with probability 2^-BITS; the
likeness takes that out: (agreement - 2^-BITS) / (1 - 2^-BITS), at least 0.

Defined cases: a text of fewer than five words has one shingle, all its words
(none for an empty or null text), so equal texts always have equal
fingerprints.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import SHINGLE, documents, table, words

BINS, BITS = 512, 4
SHIFT = 64 - (BINS - 1).bit_length()
PER_WORD = 64 // BITS
#: Probes written out before the loop over the rest of the cycle; only texts of few shingles get there.
FIRST_PROBES = 48
#: Ranges of ids whose order is found side by side.
RANGES = 1000


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the word 5-grams of a text, in order."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return _shingles(hashed)


def _shingles(hashed: Column) -> Column:
    return F.transform(F.array(hashed), lambda h: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(SHINGLE)))))[0]


def _literal(values) -> Column:
    """A constant array, folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bin_minima(hashes: Column) -> Column:
    """BINS values, null for an empty bin: one sort of the hashes together with an upper end for every bin."""
    ends = _literal((b << SHIFT | (1 << SHIFT) - 1) - (1 << 64 if b >= BINS // 2 else 0) for b in range(BINS))
    in_order = F.sort_array(F.concat(hashes, ends))

    def bin_of(h):
        return F.shiftrightunsigned(h, SHIFT)
    low = F.lit((1 << SHIFT) - 1)
    return F.transform(F.array(in_order), lambda s: F.filter(s, lambda h, i: (i == 0) | (
        bin_of(h) != bin_of(F.get(s, i - 1)))))[0], low


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text: an array of BINS * BITS / 64 longs."""
    firsts, low = _bin_minima(shingle_hashes(text))
    values = F.transform(firsts, lambda h: F.when(h.bitwiseAND(low) != low, h.bitwiseAND(low)))
    draw = random.Random(BINS)
    start = [draw.randrange(BINS) for _ in range(BINS)]
    stride = [draw.randrange(1, BINS, 2) for _ in range(BINS)]
    first = [_literal((start[i] + stride[i] * j) % BINS for i in range(BINS)).cast("array<int>") for j in range(FIRST_PROBES)]
    starts, strides = _literal(start), _literal(stride)

    def late(v, i, j):
        return F.get(v, (F.get(starts, i) + F.get(strides, i) * j).bitwiseAND(F.lit(BINS - 1)).cast("int"))

    def fill(v, x, i):
        rest = F.aggregate(F.sequence(F.lit(FIRST_PROBES), F.lit(BINS - 1)), F.lit(None).cast("bigint"),
                           lambda acc, j: F.coalesce(acc, late(v, i, j)))
        return F.coalesce(x, *(F.get(v, F.get(f, i)) for f in first), rest)
    dense = F.transform(F.array(values), lambda v: F.transform(v, lambda x, i: F.xxhash64(fill(v, x, i), i)))
    mask = F.lit((1 << BITS) - 1).cast("bigint")
    return F.transform(dense, lambda v: F.transform(
        F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), lambda k: F.aggregate(
            F.slice(v, k * PER_WORD + 1, PER_WORD), F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(mask)))))[0]


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints, 0 to 1."""
    ones = sum(1 << BITS * i for i in range(PER_WORD))

    def differ(x):
        folded = x
        for j in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, j))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))
    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: differ(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    chance = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), (1 - unequal / F.lit(float(BINS)) - chance) / (1 - chance))


def next_ids(ids: DataFrame) -> DataFrame:
    """``(doc, next)`` of a table of distinct ids: the next id in descending order, after the last the first.

    Ids are ordered inside value ranges (quantiles, so their sizes are alike);
    only one row per range is ordered as a whole."""
    cuts = ids.agg(F.percentile_approx("doc", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    bounds = _literal(sorted(set(cuts)) or [0])
    ranged = ids.withColumn("range", F.size(F.filter(bounds, lambda b: b < F.col("doc"))))
    down = Window.partitionBy("range").orderBy(F.col("doc").desc())
    tops = ranged.groupBy("range").agg(F.max("doc").alias("top"))
    over = Window.orderBy(F.col("range").desc())
    tops = tops.select("range", F.coalesce(F.lead("top").over(over), F.max("top").over(Window.partitionBy(F.lit(0)))).alias("after"))
    return ranged.withColumn("next", F.lead("doc").over(down)).join(F.broadcast(tops), "range") \
        .select("doc", F.coalesce("next", "after").alias("next"))


def fingerprints_of_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likenesses.

    The edited text replaces the last third (floor) of the code points by as
    many leading ones (or all) of the next document in descending id order;
    after the last comes the first, and a lone document follows itself. Null
    ids come last (they are read as the smallest long). Of rows that share an
    id each is edited on its own, and the one of least text hash is the next
    document of others; extra columns are left behind."""
    least = F.lit(-(2 ** 63))
    docs = documents(df, id_col, text_col).withColumn("doc", F.coalesce("doc", least))
    ids = docs.groupBy("doc").agg(F.max(F.floor(F.length("text") / 3)).alias("need"), F.min(F.xxhash64("text")).alias("of"))
    order = next_ids(ids.select("doc"))
    # of next: which text stands for it
    links = order.join(ids.select(F.col("doc"), "need"), "doc") \
        .join(ids.select(F.col("doc").alias("next"), "of"), "next") \
        .select(F.col("next").alias("doc"), F.col("doc").alias("for"), F.col("need").cast("int").alias("need"), "of")
    # one exchange of the texts, read by both joins
    spread = docs.withColumn("fp", fingerprint(F.col("text"))).repartition("doc")
    # a range, as an equality would become a join key and need an exchange of its own
    lent = spread.join(links, "doc").where(F.xxhash64("text").between(F.col("of"), F.col("of"))) \
        .select(F.col("for").alias("doc"), F.expr("left(text, need)").alias("lent"), F.col("fp").alias("next_fp")) \
        .groupBy("doc").agg(F.first("lent").alias("lent"), F.first("next_fp").alias("next_fp"))
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"),
                      F.expr("left(lent, cast(floor(length(text) / 3) as int))"))
    out = spread.join(lent, "doc").withColumn("edited", edited) \
        .withColumn("edited_fp", fingerprint(F.col("edited")))
    return out.select(F.nullif(F.col("doc"), least).alias("doc_id"), n.cast("bigint").alias("n_chars"), "edited",
                      "fp", "edited_fp", "next_fp")


@register("op8_document_fingerprints")
def op8_document_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    out = fingerprints_of_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                      likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
