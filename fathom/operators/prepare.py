"""Preparation and contract.

Role resolution and contract checks are schema-only (no job). The jobs
are: one conditional aggregate for drop counts, one dictionary build per
label-encoded column set, and the column profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fathom.bundle import Bundle, DatasetRoles, quote
from fathom.functions.stats import not_nan
from fathom.operators.profile import typed_distinct_counts
from fathom.session import written

# The synthetic alloy schema and its units.
SYNTHETIC_FEATURES = ("Al_conc_wt_pct", "Ti_conc_wt_pct", "V_conc_wt_pct",
                      "process_temperature_C", "process_time_h")
SYNTHETIC_TARGET = "hardness_HV"
SYNTHETIC_UNITS = {
    "Al_conc_wt_pct": "wt.%",
    "Ti_conc_wt_pct": "wt.%",
    "V_conc_wt_pct": "wt.%",
    "process_temperature_C": "°C",
    "process_time_h": "h",
    "hardness_HV": "HV",
}

# Above this many distinct values a column's dictionary is ranked in
# range partitions instead of one window partition per column.
RANK_IN_ONE_TASK_LIMIT = 2_000_000
# Dictionaries up to this many entries are broadcast to the encoding join.
BROADCAST_DICT_LIMIT = 1_000_000


# ---------------------------------------------------------------- P1
def _missing(df: DataFrame, c: str):
    dt = df.schema[c].dataType.typeName()
    col = F.col(quote(c))
    return ~not_nan(col) if dt in ("double", "float") else col.isNull()


def drop_missing(df: DataFrame, drop_na: bool = True) -> tuple[DataFrame, DataFrame]:
    """Drop rows with a null (or NaN) in any column, before roles are resolved.

    Returns (rows kept, one-row counts ``(before, after, dropped)``). The
    counts are one conditional aggregate over the input, not two scans.
    """
    any_missing = None
    for c in df.columns:
        m = _missing(df, c)
        any_missing = m if any_missing is None else (any_missing | m)
    if any_missing is None:
        any_missing = F.lit(False)
    counts = df.agg(F.count(F.lit(1)).alias("before"),
                    F.count(F.when(~any_missing, 1)).alias("after"))
    counts = counts.select("before", "after", (F.col("before") - F.col("after")).alias("dropped"))
    if not drop_na:
        return df, counts.select("before", F.col("before").alias("after"), F.lit(0).cast("bigint").alias("dropped"))
    # the same rows as ~any_missing, but every column is computed once: it may stand for a long expression
    for c in df.columns:
        floating = df.schema[c].dataType.typeName() in ("double", "float")
        df = df.where((F.nanvl(F.col(quote(c)), F.lit(None).cast("double")) if floating else F.col(quote(c))).isNotNull())
    return df, counts


# ---------------------------------------------------------------- P2, P8, S5
#: P2 in order of precedence: (rule, applies, roles), each over the table's columns and the given names.
ROLE_RULES = [
    ("both given", lambda cols, feats, target: bool(feats and target), lambda cols, feats, target: (list(feats), target)),
    ("target given", lambda cols, feats, target: bool(target),
     lambda cols, feats, target: ([c for c in cols if c != target], target)),
    ("synthetic columns", lambda cols, feats, target: {SYNTHETIC_TARGET, *SYNTHETIC_FEATURES} <= set(cols),
     lambda cols, feats, target: (list(SYNTHETIC_FEATURES), SYNTHETIC_TARGET)),
    ("last column", lambda cols, feats, target: True, lambda cols, feats, target: (list(cols[:-1]), cols[-1])),
]


def resolve_roles(columns: list[str], config: dict) -> tuple[list[str], str]:
    """(features, target) by the first rule of ``ROLE_RULES`` that applies; features alone are ignored."""
    given = (columns, config.get("features"), config.get("target"))
    return next(roles(*given) for _, applies, roles in ROLE_RULES if applies(*given))


def default_units(features: list[str], target: str, units: dict | None) -> dict:
    """The synthetic units when none are given and the roles are the synthetic ones."""
    if units:
        return dict(units)
    if target == SYNTHETIC_TARGET and list(features) == list(SYNTHETIC_FEATURES):
        return dict(SYNTHETIC_UNITS)
    return {}


def dataset_description(features: list[str], target: str, name: str) -> tuple[str, str]:
    """Default (source, description) for a table loaded from ``name``."""
    feats = "[" + ", ".join(repr(f) for f in features) + "]"
    return name, f"Dataset loaded from '{name}' | features: {feats} | target: '{target}'"


# ---------------------------------------------------------------- P3
def _rank_dictionary(distinct: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Assign 0-based codes in value order per column: ``(column, value, code)``.

    Columns up to ``RANK_IN_ONE_TASK_LIMIT`` distinct values rank in one
    window partition each. Larger ones are range-partitioned on
    ``(column, value)``, checkpointed so every later use sees the same
    partition layout, counted per partition, and coded as the partition's
    offset plus the rank inside it — no task holds a whole column.
    """
    small = [c for c, n in sizes.items() if n <= RANK_IN_ONE_TASK_LIMIT]
    large = [c for c, n in sizes.items() if n > RANK_IN_ONE_TASK_LIMIT]
    parts = []
    if small:
        w = Window.partitionBy("column").orderBy("value")
        parts.append(distinct.where(F.col("column").isin(small))
                     .select("column", "value", (F.row_number().over(w) - 1).cast("bigint").alias("code")))
    if large:
        n_parts = max(1, sum(sizes[c] for c in large) // 1_000_000)
        ranged = (distinct.where(F.col("column").isin(large))
                  .repartitionByRange(n_parts, "column", "value")
                  .withColumn("pid", F.spark_partition_id())
                  .checkpoint(eager=True))
        counts = ranged.groupBy("column", "pid").agg(F.count(F.lit(1)).alias("n"))
        wo = Window.partitionBy("column").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("column", "pid", F.coalesce(F.sum("n").over(wo), F.lit(0)).alias("offset"))
        wr = Window.partitionBy("column", "pid").orderBy("value")
        parts.append(ranged.join(F.broadcast(offsets), ["column", "pid"])   # one row per range partition
                     .select("column", "value",
                             (F.col("offset") + F.row_number().over(wr) - 1).cast("bigint").alias("code")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_encode(df: DataFrame, feature_cols: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Replace each text feature by the 0-based rank of ``str(value)``.

    A null that survived P1 becomes the class ``'nan'``. Returns
    (encoded df, dictionary ``(column, code, class)``). Codes are plain
    bigints without nominal metadata (trees see them as ordered numbers, as
    the reference's do). Booleans are not encoded.
    """
    text_cols = [c for c in feature_cols
                 if c in df.columns and df.schema[c].dataType.typeName() == "string"]
    if not text_cols:
        return df, None
    texts = {c: F.coalesce(F.col(c), F.lit("nan")) for c in text_cols}
    long = df.select([texts[c].alias(c) for c in text_cols]).unpivot([], text_cols, "column", "value")
    # one scan of the table, however many text columns it has
    distinct = written(long.distinct(), "distinct-values")
    sizes = {r["column"]: int(r["n"]) for r in
             distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per column
    dictionary = written(_rank_dictionary(distinct, sizes), "dictionary")
    out = df
    for c in text_cols:
        d = dictionary.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        if sizes.get(c, 0) <= BROADCAST_DICT_LIMIT:
            d = F.broadcast(d)
        out = (out.withColumn("_v", texts[c]).join(d, "_v", "left")
                  .withColumn(c, F.col("_code")).drop("_v", "_code"))
    dict_df = dictionary.select("column", "code", F.col("value").alias("class"))
    return out.select(df.columns), dict_df


# ---------------------------------------------------------------- P4
def contract_violations(columns: list[str], roles: DatasetRoles) -> list[tuple[str, str]]:
    """List of (rule, column) breaking the contract, in the reference's check order."""
    out = [("missing_feature", c) for c in roles.features if c not in columns]
    if roles.target not in columns:
        out.append(("missing_target", roles.target))
    if roles.units:
        out += [("missing_unit", c) for c in list(roles.features) + [roles.target] if c not in roles.units]
    if not roles.source:
        out.append(("empty_source", ""))
    if not roles.description:
        out.append(("empty_description", ""))
    return out


# The texts of the contract's errors.
MESSAGES = {
    "missing_feature": "Missing feature columns in DataFrame: {cols}",
    "missing_target": "Target column '{col}' not found in DataFrame",
    "missing_unit": "Missing units for columns: {cols}",
    "empty_source": "schema.source must be a non-empty string",
    "empty_description": "schema.description must be a non-empty string",
}


def validate_contract(df: DataFrame, roles: DatasetRoles) -> None:
    """Raise on the first broken rule (schema only, no job)."""
    v = contract_violations(df.columns, roles)
    if not v:
        return
    rule = v[0][0]
    cols = [c for r, c in v if r == rule]
    raise ValueError(MESSAGES[rule].format(cols=cols, col=cols[0]))


# ---------------------------------------------------------------- P5
def dataset_metadata(bundle: Bundle) -> DataFrame:
    """P5: one row of roles, units, source, description, shape and dtypes.

    Flat text columns (``features``/``units``/``dtypes`` as 'a,b' and
    'k=v;...') plus ``n_rows`` from a single count.
    """
    df, roles = bundle.df, bundle.roles
    dtypes = ";".join(f"{f.name}={f.dataType.simpleString()}" for f in df.schema.fields)
    units = ";".join(f"{k}={v}" for k, v in roles.units.items())
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(",".join(roles.features)).alias("features"), F.lit(roles.target).alias("target"),
        F.lit(units).alias("units"), F.lit(roles.source).alias("source"),
        F.lit(roles.description).alias("description"), "n_rows",
        F.lit(len(df.columns)).alias("n_cols"), F.lit(dtypes).alias("dtypes"))


# ---------------------------------------------------------------- P6, P7
def profile_columns(df: DataFrame) -> DataFrame:
    """``(column, ord, dtype, n_unique, null_pct)`` for every column.

    Null shares come from one single-row aggregate; distinct counts from
    the two-level grouped count over the unpivoted text form.
    """
    cols = df.columns
    present = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count(F.when(~_missing(df, c), 1)).alias(f"c{i}") for i, c in enumerate(cols)])
    long_counts = present.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ord"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col(f"c{i}").alias("nn"))
        for i, c in enumerate(cols)])).alias("s")).select("_rows", "s.*")
    nu = typed_distinct_counts(df, cols, lambda c: ~_missing(df, c))
    return (long_counts.join(F.broadcast(nu), "column", "left")   # nu: one row per column
            .select("column", "ord", "dtype", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"),
                    F.round((F.col("_rows") - F.col("nn")) * 100.0 / F.col("_rows"), 1).alias("null_pct"))
            .orderBy("ord"))


def sample_head(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows by an explicit order key (per-partition top-n, then merge)."""
    return df.orderBy(*order_by).limit(n)
