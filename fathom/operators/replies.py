"""Structured suggestions and plans from a table of stored replies.

A reply table ``(id, response)`` is parsed in bulk with native functions:
fences are stripped by ``regexp_replace``, the JSON array is cut by a
bracket-depth scan, parsed with ``try_parse_json`` (variant), exploded with
positions and checked per element. The model table (33 rows, fixed by the
registry) is broadcast. No Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.plans.registry_models import (DEFAULT_SUGGESTION, IMPORT_TO_PIP, MODEL_IMPORT_MAP, import_path,
                                          package_of)

# Plan actions and the default plan of the reference.
PLAN_ACTIONS = ("select_model", "train", "evaluate", "interpret")
DEFAULT_PLAN = (
    ("select_model", "Select ML model based on data distribution"),
    ("train", "Split data, train model with hyperparameter tuning"),
    ("evaluate", "Compute metrics and generate plots on test set"),
    ("interpret", "Summarize results and suggest improvements"),
)
REQUIRED_KEYS = ("model_name", "package", "reason")
FENCE = r"```(?:json)?\s*"


# ------------------------------------------------------------------ L1
def clean_reply(c: Column) -> Column:
    """Remove code fences (with the whitespace after them) and trim."""
    return F.regexp_replace(F.regexp_replace(c, FENCE, ""), r"^\s+|\s+$", "")


def _balanced_end(sub: Column, open_: str, close: str) -> Column:
    """1-based position in ``sub`` (which starts with ``open_``) of its matching close.

    Every ``open_``/``close`` counts, even inside JSON strings. Only the
    bracket sequence is scanned: its k-th bracket sits after the first k
    text pieces between brackets. Null when the depth never returns to 0.
    """
    pat = "[" + "\\" + open_ + "\\" + close + "]"
    brackets = F.regexp_extract_all(sub, F.lit("(" + pat + ")"), 1)
    pieces = F.split(sub, pat, -1)
    scan = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("end"), F.lit(0).alias("i")),
        lambda acc, b: F.struct(
            (acc["depth"] + F.when(b == open_, 1).otherwise(-1)).alias("depth"),
            F.when((acc["end"] < 0) & (acc["depth"] + F.when(b == open_, 1).otherwise(-1) == 0), acc["i"])
             .otherwise(acc["end"]).alias("end"),
            (acc["i"] + 1).alias("i")))
    j = scan["end"]
    text_before = F.aggregate(F.slice(pieces, 1, j + 1), F.lit(0), lambda a, p: a + F.length(p))
    return F.when(j >= 0, text_before + j + 1)


def extract_json_array(df: DataFrame, col: str = "response") -> DataFrame:
    """L1: add ``json`` — the first '[' through its matching ']' of the cleaned reply, or null."""
    cleaned = clean_reply(F.col(col))
    start = F.instr(cleaned, "[")
    sub = F.substring(cleaned, start, 2 ** 31 - 1)
    end = _balanced_end(sub, "[", "]")
    return df.withColumn("json", F.when((start > 0) & end.isNotNull(), F.substring(sub, 1, end)))


def extract_json_object(df: DataFrame, col: str = "response") -> DataFrame:
    """L3 input: first '{' through the last '}' of the cleaned reply, when it has no '['."""
    cleaned = clean_reply(F.col(col))
    first = F.instr(cleaned, "{")
    last = F.length(cleaned) - F.instr(F.reverse(cleaned), "}") + 1
    ok = (F.instr(cleaned, "[") == 0) & (first > 0) & (F.instr(cleaned, "}") > 0) & (last >= first)
    return df.withColumn("json_obj", F.when(ok, F.substring(cleaned, first, last - first + 1)))


# ------------------------------------------------------------------ L4
def normalize_package(model: Column, package: Column, known: Column) -> Column:
    """L4 for a known model's package: dotted text -> scikit-learn; 'sklearn' (any case) -> scikit-learn."""
    dotted = F.when(F.instr(package, ".") > 0,
                    F.when(known, F.lit("scikit-learn")).otherwise(F.split_part(package, F.lit("."), F.lit(1)))) \
              .otherwise(package)
    return F.when(F.lower(F.trim(dotted)) == "sklearn", F.lit("scikit-learn")).otherwise(dotted)


def package_from_import_path(path: Column) -> Column:
    """L4 from an import path: first segment mapped to its pip name; no dot -> the path itself."""
    top = F.split_part(path, F.lit("."), F.lit(1))
    mapping = F.create_map(*[x for k, v in IMPORT_TO_PIP.items() for x in (F.lit(k), F.lit(v))])
    return (F.when((path.isNull()) | (path == ""), F.lit("scikit-learn"))
             .when(F.instr(path, ".") == 0, path)
             .otherwise(F.coalesce(mapping[top], top)))


# ------------------------------------------------------------------ lenient JSON
def _read(text: Column) -> Column:
    """Variant of a JSON text as Python's parser takes it: NaN and Infinity are values (null here), and the
    last of repeated keys counts. Strings are stepped over; a text that holds the marker itself is not JSON."""
    marked = F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|-?\bInfinity\b|\bNaN\b', "$1\u0001")
    plain = F.replace(F.replace(marked, F.lit('"\u0001'), F.lit('"')), F.lit("\u0001"), F.lit("null"))
    return F.try_parse_json(plain)


def _allow_repeated_keys(spark) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


# ------------------------------------------------------------------ L2, L3, L6
def _registry_table(spark) -> DataFrame:
    rows = [(n, import_path(n)) for n in sorted(MODEL_IMPORT_MAP)]
    return spark.createDataFrame(rows, "_known string, _path string")


def _text(v: Column, path: str) -> Column:
    """String value at ``path`` of a variant (JSON null or absent -> null; other types as JSON text)."""
    sub = F.try_variant_get(v, path, "variant")
    return (F.when(sub.isNull() | F.is_variant_null(sub), F.lit(None).cast("string"))
             .otherwise(F.coalesce(F.try_variant_get(v, path, "string"), F.to_json(sub))))


def _suggestions_from(items: DataFrame) -> DataFrame:
    """Apply the element rules to ``(id, pos, item variant)``."""
    spark = items.sparkSession
    is_obj = F.schema_of_variant(F.col("item")).startswith("OBJECT")
    keys = F.json_object_keys(F.to_json(F.col("item")))
    has_all = F.forall(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), lambda k: F.array_contains(keys, k))
    objs = items.where(is_obj & has_all).select(
        "id", "pos",
        _text(F.col("item"), "$.model_name").alias("model_name"),
        _text(F.col("item"), "$.package").alias("package_raw"),
        _text(F.col("item"), "$.import_path").alias("path_raw"),
        _text(F.col("item"), "$.reason").alias("reason"))
    reg = F.broadcast(_registry_table(spark))     # 33 fixed rows
    j = objs.join(reg, objs["model_name"] == reg["_known"], "left")
    known = F.col("_known").isNotNull()
    given_path = F.col("path_raw").isNotNull() & (F.col("path_raw") != "")
    return (j.where(known | given_path)
             .select("id", "pos", "model_name",
                     F.when(known, normalize_package(F.col("model_name"), F.col("package_raw"), F.lit(True)))
                      .otherwise(package_from_import_path(F.col("path_raw"))).alias("package"),
                     F.when(known, F.col("_path")).otherwise(F.col("path_raw")).alias("import_path"),
                     "reason"))


def candidates(replies: DataFrame, id_col: str = "id", col: str = "response") -> DataFrame:
    """``(id, json, json_obj)`` from one projection over the cleaned reply text."""
    base = replies.select(F.col(id_col).alias("id"), clean_reply(F.col(col)).alias("cl"))
    start = F.instr(F.col("cl"), "[")
    sub = F.substring(F.col("cl"), start, 2 ** 31 - 1)
    end = _balanced_end(sub, "[", "]")
    first = F.instr(F.col("cl"), "{")
    last = F.length(F.col("cl")) - F.instr(F.reverse(F.col("cl")), "}") + 1
    has_obj = (start == 0) & (first > 0) & (F.instr(F.col("cl"), "}") > 0) & (last >= first)
    return base.select("id", F.when((start > 0) & end.isNotNull(), F.substring(sub, 1, end)).alias("json"),
                       F.when(has_obj, F.substring(F.col("cl"), first, last - first + 1)).alias("json_obj"))


def parse_suggestions(replies: DataFrame, id_col: str = "id", col: str = "response") -> DataFrame:
    """L2 + L3: ``(id, pos, model_name, package, import_path, reason)``.

    With a '[' in the cleaned reply the bracket-matched array is used (none
    found or invalid JSON -> nothing); without one, the first '{' to the last
    '}' is read as a single suggestion (pos 0). One pass: both candidates come
    from one projection and a single ``posexplode`` yields the items.
    """
    _allow_repeated_keys(replies.sparkSession)
    c = candidates(replies, id_col, col)
    arr = F.try_variant_get(_read(F.col("json")), "$", "array<variant>")
    obj = _read(F.col("json_obj"))
    items = F.when(F.col("json").isNotNull(), arr).when(obj.isNotNull(), F.array(obj))
    exploded = c.select("id", F.posexplode(items).alias("pos", "item"))
    return _suggestions_from(exploded)


def default_suggestion_fill(replies: DataFrame, parsed: DataFrame, id_col: str = "id") -> DataFrame:
    """Replies that yield nothing get the default suggestion — always the regressor's."""
    name, pkg, path, reason = DEFAULT_SUGGESTION["regression"]
    ids = replies.select(F.col(id_col).alias("id"))
    missing = ids.join(parsed.select("id").distinct(), "id", "left_anti")
    fill = missing.select("id", F.lit(0).alias("pos"), F.lit(name).alias("model_name"), F.lit(pkg).alias("package"),
                          F.lit(path).alias("import_path"), F.lit(reason).alias("reason"))
    return parsed.unionByName(fill)


def suggestions(replies: DataFrame, id_col: str = "id", col: str = "response") -> DataFrame:
    """L2 + L3 + L6: every reply's suggestions, the default where none parse."""
    return default_suggestion_fill(replies, parse_suggestions(replies, id_col, col), id_col)


# ------------------------------------------------------------------ L5, L8
def _py_str(v: Column, present: Column) -> Column:
    """Python ``str()`` of a JSON value: text as is, null -> 'None', booleans -> 'True'/'False';
    an absent key gives ''."""
    t = F.schema_of_variant(v)
    return (F.when(~present, F.lit(""))
             .when(v.isNull() | F.is_variant_null(v), F.lit("None"))
             .when(t == "STRING", F.try_variant_get(v, "$", "string"))
             .when(t == "NULL", F.lit("None"))
             .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False"))
             .otherwise(F.to_json(v)))


def parse_plan(replies: DataFrame, id_col: str = "id", col: str = "response") -> DataFrame:
    """``(id, pos, action, description)``; replies with no valid step get the default plan."""
    _allow_repeated_keys(replies.sparkSession)
    r = extract_json_array(replies.select(F.col(id_col).alias("id"), F.col(col).alias("r")), "r")
    arr = F.try_variant_get(_read(F.col("json")), "$", "array<variant>")
    items = r.select("id", F.posexplode(arr).alias("src_pos", "item"))
    is_obj = F.schema_of_variant(F.col("item")).startswith("OBJECT")
    action = F.try_variant_get(F.col("item"), "$.action", "string")
    is_string = F.schema_of_variant(F.try_variant_get(F.col("item"), "$.action", "variant")) == "STRING"
    steps = (items.where(is_obj & is_string & action.isin(list(PLAN_ACTIONS)))
                  .select("id", "src_pos", action.alias("action"),
                          _py_str(F.try_variant_get(F.col("item"), "$.description", "variant"),
                                  F.array_contains(F.json_object_keys(F.to_json(F.col("item"))), "description"))
                          .alias("description")))
    from pyspark.sql import Window
    w = Window.partitionBy("id").orderBy("src_pos")     # only the kept steps of one reply
    kept = steps.select("id", (F.row_number().over(w) - 1).alias("pos"), "action", "description")
    ids = replies.select(F.col(id_col).alias("id"))
    missing = ids.join(kept.select("id").distinct(), "id", "left_anti")
    plan = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("action"), F.lit(d).alias("description"))
                     for i, (a, d) in enumerate(DEFAULT_PLAN)])
    fill = missing.select("id", F.inline(plan))
    return kept.select("id", F.col("pos").cast("int").alias("pos"), "action", "description").unionByName(
        fill.select("id", "pos", "action", "description"))


def plan_descriptions(plan: DataFrame) -> DataFrame:
    """Ordered step texts — the description, or the action when there is none."""
    return plan.select("id", "pos", F.coalesce(F.col("description"), F.col("action")).alias("step"))
