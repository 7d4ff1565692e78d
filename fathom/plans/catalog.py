"""Registered queries: each op of the blueprint run over the given tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where SQL can state the
same result, ``ORACLE[name]`` — DuckDB SQL over views of the same tables.
Inputs that the tables lack (nulls, text numbers, reply texts) are derived
from the tables by the shared ``inputs`` helpers, identically in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
