"""The registered corpus queries and, where SQL can state them, their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["chat", "url_filter", "fingerprint", "decontaminate", "line_dedup", "jaccard_join", "suffix_dedup", "toxicity", "pieces", "chains", "exact_dedup", "lexical_search", "periodic_runs"]

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _load():
    for m in MODULES:
        importlib.import_module(f"fathom.llm.{m}")
    import corpus_pipeline
    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
