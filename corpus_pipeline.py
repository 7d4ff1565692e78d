"""The corpus pipeline: from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``:

1. toxicity: documents that the score rejects (0.5 or more) go.
2. line dedup: lines of templates that recur across documents go, but for the
   first one; ``n_chars`` follows the text. Documents stay, also when no line
   is left.
3. n-gram Jaccard join: one document of each class of near duplicates stays.
4. benchmark decontamination: documents that overlap a benchmark item go.
5. SentencePiece: every document as ids, packed in 32 bits each, and the text
   that they decode to.

All but the last return the columns of ``documents``; nulls, ties, repeated
rows and empty tables are as each operator's docstring says.
"""

from pyspark.sql import functions as F

from fathom.llm import decontaminate, jaccard_join, line_dedup, pieces, toxicity
from fathom.llm.common import table, written


def _columns(docs):
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark, docs, sf_dir):
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark, docs, sf_dir):
    out = line_dedup.without_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_columns(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    return jaccard_join.one_of_each(docs).select(*_columns(docs))


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.without_contaminated(docs, decontaminate.benchmark_items(spark, sf_dir)).select(*_columns(docs))


def encode_and_decode(spark, docs, sf_dir):
    out = pieces.encode_decode(docs)
    return out.select(F.col("doc").alias("doc_id"), F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"), "ids", "text")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_recurring_lines), ("ngram_jaccard_join", drop_near_duplicates),
          ("benchmark_decontamination", drop_contaminated), ("sentencepiece", encode_and_decode)]

#: A trained score and token ids are not SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
