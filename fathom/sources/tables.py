"""Pluggable table loader behind one contract.

``load_table(spark, config)`` reads any Spark source and runs the loader
flow: P1 drop -> P2 roles -> P3 encode -> P8 units -> S5 labels -> P4 check.
Name checks happen before any job; the jobs are the drop count (optional)
and the encoder dictionary.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from fathom.bundle import Bundle, DatasetRoles
from fathom.operators.prepare import (dataset_description, default_units, drop_missing,
                                      label_encode, resolve_roles, validate_contract)
from fathom.sources.csv import csv_source

LOADERS = {}


def loader(name):
    def deco(fn):
        LOADERS[name] = fn
        return fn
    return deco


@loader("parquet")
def _parquet(spark, cfg):
    return spark.read.parquet(cfg["path"])


@loader("orc")
def _orc(spark, cfg):
    return spark.read.orc(cfg["path"])


@loader("json")
def _json(spark, cfg):
    return spark.read.json(cfg["path"])


@loader("csv")
def _csv(spark, cfg):
    return csv_source(spark, cfg.get("path"))


@loader("table")
def _table(spark, cfg):
    return spark.table(cfg["table"])


def _format_of(cfg) -> str:
    if cfg.get("format"):
        return cfg["format"]
    if cfg.get("table"):
        return "table"
    ext = os.path.splitext(str(cfg.get("path", "")).rstrip("/"))[1].lower().lstrip(".")
    return ext if ext in LOADERS else "csv"   # unknown extensions are tried as CSV


def read_table(spark: SparkSession, cfg: dict) -> DataFrame:
    if not cfg.get("path") and not cfg.get("table") and cfg.get("df") is None:
        raise ValueError("config['path'] is required")
    if cfg.get("df") is not None:
        return cfg["df"]
    return LOADERS[_format_of(cfg)](spark, cfg)


def load_table(spark: SparkSession, cfg: dict) -> Bundle:
    df = read_table(spark, cfg)
    if cfg.get("drop_na", True):
        df, _ = drop_missing(df)
    features, target = resolve_roles(df.columns, cfg)
    missing = [c for c in features if c not in df.columns]
    encoding = None
    if cfg.get("encode_categoricals", True) and not missing:
        df, encoding = label_encode(df, features)
    units = default_units(features, target, cfg.get("units"))
    name = os.path.basename(str(cfg.get("path") or cfg.get("table") or "dataframe").rstrip("/"))
    src, desc = dataset_description(features, target, name)
    roles = DatasetRoles(tuple(features), target, units, cfg.get("source", src), cfg.get("description", desc))
    validate_contract(df, roles)
    return Bundle(with_role_metadata(df, roles), roles, encoding)


def with_role_metadata(df: DataFrame, roles: DatasetRoles) -> DataFrame:
    """Attach role and unit to the schema of each feature and the target (no job)."""
    for c in list(roles.features) + [roles.target]:
        meta = {"role": "target" if c == roles.target else "feature"}
        if c in roles.units:
            meta["unit"] = roles.units[c]
        df = df.withMetadata(c, meta)
    return df
