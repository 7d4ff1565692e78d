"""Loads every registered query module and exposes the two tables."""

from __future__ import annotations

import importlib

from fathom.plans.catalog import ORACLE, QUERIES

MODULES = ["fathom.plans.reg_prepare", "fathom.plans.reg_profile", "fathom.plans.reg_splits", "fathom.plans.reg_models", "fathom.plans.reg_replies", "fathom.plans.reg_runs", "fathom.plans.reg_closed", "fathom.plans.reg_trees", "fathom.plans.reg_logistic"]


def _load():
    for m in MODULES:
        importlib.import_module(m)


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
