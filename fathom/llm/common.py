"""Shared pieces of the corpus operators.

A document is identified by its id together with a hash of its text, so
tables with repeated ids keep every row: rows that repeat both id and text are
one document, and each of them receives that document's result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.session import written

__all__ = ["SHINGLE", "SIMILARITY", "complete_groups", "documents", "ship", "short_batches", "table", "words", "written"]

#: Words of a shingle and the least similarity of near duplicates.
SHINGLE = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, text)`` of any table of texts; null texts are empty, other columns are left behind."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches of this session (64 MB by default, in both processes and for every core).

    A batch has 10,000 texts of any length otherwise; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(64 << 20)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def complete_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cuts sorted batches so that no group of equal ``key`` is split between two frames.

    The caller bounds the size of a group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[key]
        last = (k == k.iloc[-1]).all(axis=1).to_numpy()
        cut = len(b) - int(last[::-1].argmin()) if not last.all() else 0
        if cut == 0 and held and (held[-1][key].iloc[-1] == k.iloc[0]).all():
            held.append(b)
            continue
        if cut == 0:
            if held:
                yield pd.concat(held, ignore_index=True)
            held = [b]
            continue
        done = pd.concat([*held, b.iloc[:cut]], ignore_index=True)
        held = [b.iloc[cut:]]
        yield done
    if held:
        yield pd.concat(held, ignore_index=True)


def ship(name: str) -> None:
    """Sends the Python functions of module ``name`` by value, so workers need no copy of this package."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)
