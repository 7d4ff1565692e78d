"""Exact deduplication by progressive refinement.

Texts are equal when they are identical without white space (blank, tab, line
feed, vertical tab, form feed, carriage return). Three levels, each over what
the one before has left:

1. length of the normalised text; lengths of one document are done;
2. hash of its first ``PREFIX`` characters within a length; groups of one are done;
3. SHA-256 of the whole normalised text, only for documents whose (length,
   prefix hash) has survived.

The first two levels count one short row a document, combined before the
shuffle. What survives a level comes back to the next as a set of
at most ``SLOTS`` numbers (hashes modulo ``SLOTS``: a proven size, so it is
broadcast): no row is joined by its length, of which a third of all may have
the same, and the third hash is computed where the text lies, so no text is
shuffled. A document that only shares a survivor's slot goes on to the next level and ends
in a group of its own, so the result does not depend on ``SLOTS``. Of the third
level one short row a document is written, and its groups are joined back to it;
a group of a third of all rows is one combined row on one side and split by
AQE on the other.

Of equal texts the row with the most characters in the original text stays,
then the one with the smallest id, then the least hash of the original text; of
rows that are alike in all of these, one.

Defined cases: a null text is empty; empty texts and those of white space only
are equal; null ids come after all others; rows that repeat id and text are
rows of their own, one of which may stay; extra columns are left behind; an
empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import documents, table, written

#: Characters of the normalised text that the second level hashes.
PREFIX = 64
#: Most numbers that are broadcast to the third level.
SLOTS = 1 << 20


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return F.regexp_replace(text, "[ \\t-\\r]+", "")


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, text) with its normalised text ``norm``, its length in bytes and the hash of its first characters."""
    return docs.withColumn("norm", normalised(F.col("text"))).withColumn("len", F.octet_length("norm")) \
        .withColumn("prefix", F.xxhash64(F.substring("norm", 1, PREFIX)))


def _slot(slots: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(slots)).alias("slot")


def _surviving(marks: DataFrame, slots: int, *by: str) -> DataFrame:
    """The slots of the groups of several documents: ``slots`` numbers at most."""
    groups = marks.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return groups.select(_slot(slots, *by)).distinct().withColumn("survives", F.lit(True))


def surviving_prefixes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot, survives`` of the (length, prefix hash) of several documents after the first two levels; ``docs`` is (doc, text)."""
    marks = written(_marked(docs).select("len", "prefix"), "marks")
    same_length = marks.join(F.broadcast(_surviving(marks, slots, "len")), _slot(slots, "len") == F.col("slot"), "left_semi")
    return _surviving(same_length, slots, "len", "prefix")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, slots: int = SLOTS) -> DataFrame:
    """``doc, keep_id, group_size, kept, digest`` of every row.

    ``digest`` is the SHA-256 of the normalised text of the rows that reached the third level. With ``digests`` the others get
    theirs as well, which their groups do not depend on."""
    docs = documents(df, id_col, text_col)
    survivors = surviving_prefixes(docs, slots)
    read = _marked(docs).withColumn("slot", _slot(slots, "len", "prefix")).join(F.broadcast(survivors), "slot", "left")
    whole = F.sha2("norm", 256)
    rows = written(read.select(
        "doc", F.length("text").alias("chars"), F.xxhash64("text").alias("original"), F.coalesce("survives", F.lit(False)).alias("survives"),
        whole.alias("digest") if digests else F.when(F.col("survives"), whole).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "refined")      # the row numbers stay as written
    order = F.struct((-F.col("chars")).alias("less"), F.col("doc").isNull().alias("last"), "doc", "original", "row")
    groups = written(rows.where("survives").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1"), "groups")
    # the groups grow with the corpus: they are not to be broadcast where they happen to be few
    found = rows.where("survives").join(groups.hint("merge"), "digest", "left")
    several = F.col("first").isNotNull()
    return found.select("doc", F.when(several, F.col("first.doc")).otherwise(F.col("doc")).alias("keep_id"),
                        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
                        F.when(several, F.col("row") == F.col("first.row")).otherwise(True).alias("kept"), "digest") \
        .unionByName(rows.where("not survives").select("doc", F.col("doc").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                                       F.lit(True).alias("kept"), "digest"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) = 1 AS kept, text_sha256
FROM rows
"""


@register("op12_exact_dedup", SQL)
def op12_exact_dedup(spark, sf_dir):
    """Every document with the one that stays of its group of equal texts."""
    out = exact_dedup(table(spark, sf_dir, "documents"), digests=True)
    return out.withColumnsRenamed({"doc": "doc_id", "digest": "text_sha256"})
