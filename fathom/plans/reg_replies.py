"""Registered queries for reply parsing.

The reply table is shaped from ``conversations``: every turn's whole text
becomes the reason (JSON-escaped) inside one of ten reply shapes picked by
a hash of the reply id — fenced arrays, arrays in prose, single objects,
the old ``MODEL:`` line format, plain prose, mixed arrays with brackets in
strings, unbalanced brackets, plans, and arrays with odd values. The same
rule is written in Spark and in SQL; no parsing happens here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import replies as L
from fathom.plans.catalog import register, table
from fathom.plans.registry_models import MODEL_IMPORT_MAP

MODELS = sorted(MODEL_IMPORT_MAP)

# Reply templates; {T} = escaped text, {M1}/{M2} = model names picked by hash.
SHAPES = (
    '```json\n[{"model_name": "{M1}", "package": "scikit-learn", "import_path": "x.y", "reason": "{T}"}, '
    '{"model_name": "{M2}", "package": "sklearn", "reason": "{T}"}]\n```',
    '[{"model_name": "{M1}", "package": "sklearn.linear_model", "reason": "{T}"}]',
    'Here you go: [{"model_name": "CustomNet", "package": "whatever", "import_path": "mylib.models.CustomNet", '
    '"reason": "{T}"}, {"model_name": "Other", "package": "x", "reason": "{T}"}] thanks',
    '{"model_name": "{M1}", "package": "scikit-learn", "reason": "{T}"}',
    'MODEL: {M1}\nPACKAGE: scikit-learn',
    '{RAW}',
    '```\n[{"model_name": "{M1}", "package": "scikit-learn", "reason": "see [b] here {T}"}, 42, '
    '{"model_name": "{M2}", "package": "xgboost", "reason": null}, {"model_name": "{M2}"}]\n```\n'
    'More text after [the array].',
    '[{"model_name": "{M1}", "package": "scikit-learn", "reason": "unbalanced [ bracket {T}"}',
    '[{"action": "select_model", "description": "{T}"}, {"action": "train", "description": "fit"}, '
    '{"action": "evaluate"}, {"action": "report", "description": "x"}, {"action": "interpret", "description": null}, '
    '{"action": "train", "description": true}]',
    '[{"model_name": "{M1}", "package": "scikit-learn", "import_path": "sklearn.x.M", "reason": "{T}"}, '
    '{"model_name": 7, "package": "p", "import_path": "solo", "reason": "{T}"}]',
)


def _escape(c):
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    c = F.regexp_replace(c, r"\\", r"\\\\")
    c = F.regexp_replace(c, '"', r'\\"')
    c = F.regexp_replace(c, "\n", r"\\n")
    c = F.regexp_replace(c, "\r", r"\\r")
    return F.regexp_replace(c, "\t", r"\\t")


def _pick(key, salt: str, n: int):
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 6), 16, 10).cast("bigint"),
                  F.lit(n))


def reply_table(spark, sf):
    """``(id, response)``: one reply per conversation turn.

    The source file is one row group; it is dealt to 16 partitions by key, as a
    reply table of real size would already be."""
    c = table(spark, sf, "conversations").repartition(16, "conv_id", "turn")
    rid = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    base = c.select(rid, F.col("text"))
    shape = _pick(F.col("id"), "|shape", len(SHAPES))
    m1 = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (_pick(F.col("id"), "|m1", len(MODELS)) + 1).cast("int"))
    m2 = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (_pick(F.col("id"), "|m2", len(MODELS)) + 1).cast("int"))
    esc = _escape(F.col("text"))

    def render(tpl: str):
        if tpl == "{RAW}":
            return F.col("text")
        parts, rest = [], tpl
        while rest:
            nxt = min([(rest.find(t), t) for t in ("{T}", "{M1}", "{M2}") if rest.find(t) >= 0], default=None)
            if nxt is None:
                parts.append(F.lit(rest))
                break
            i, tok = nxt
            parts.append(F.lit(rest[:i]))
            parts.append({"{T}": esc, "{M1}": m1, "{M2}": m2}[tok])
            rest = rest[i + len(tok):]
        return F.concat(*parts)

    resp = None
    for i, tpl in enumerate(SHAPES):
        resp = F.when(shape == i, render(tpl)) if resp is None else resp.when(shape == i, render(tpl))
    return base.select("id", resp.alias("response"))


def _sql_escape(x: str) -> str:
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    x = f"regexp_replace({x}, '\\\\', '\\\\\\\\', 'g')"
    x = f"regexp_replace({x}, '\"', '\\\\\"', 'g')"
    x = f"regexp_replace({x}, chr(10), '\\\\n', 'g')"
    x = f"regexp_replace({x}, chr(13), '\\\\r', 'g')"
    return f"regexp_replace({x}, chr(9), '\\\\t', 'g')"


def _sql_pick(key: str, salt: str, n: int) -> str:
    return f"((('0x' || left(md5(cast({key} as varchar) || '{salt}'), 6))::bigint) % {n})"


def _sql_render(tpl: str) -> str:
    if tpl == "{RAW}":
        return "text"
    out, rest = [], tpl
    while rest:
        found = [(rest.find(t), t) for t in ("{T}", "{M1}", "{M2}") if rest.find(t) >= 0]
        if not found:
            out.append("'" + rest.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
            break
        i, tok = min(found)
        if i:
            out.append("'" + rest[:i].replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        out.append({"{T}": "esc", "{M1}": "m1", "{M2}": "m2"}[tok])
        rest = rest[i + len(tok):]
    return " || ".join(out)


def replies_sql() -> str:
    models = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
    cases = "\n".join(f"      when {i} then {_sql_render(t)}" for i, t in enumerate(SHAPES))
    return f"""
rep as (
  select id, case shape
{cases}
    end as response
  from (select conv_id * 1000 + turn as id, text, {_sql_escape('text')} as esc,
               {_sql_pick('conv_id * 1000 + turn', '|shape', len(SHAPES))} as shape,
               {models}[{_sql_pick('conv_id * 1000 + turn', '|m1', len(MODELS))} + 1] as m1,
               {models}[{_sql_pick('conv_id * 1000 + turn', '|m2', len(MODELS))} + 1] as m2
        from conversations))"""


L1_SQL = "with " + replies_sql().strip() + r""",
c as (select id, regexp_replace(regexp_replace(response, '```(?:json)?\s*', '', 'g'), '^\s+|\s+$', '', 'g') as cl from rep),
t as (select id, substring(cl, instr(cl, '[')) as sub from c where instr(cl, '[') > 0),
b as (select id, sub, regexp_extract_all(sub, '([\[\]])', 1) as br, string_split_regex(sub, '[\[\]]') as pieces from t),
u as (select id, unnest(br) as x, generate_subscripts(br, 1) as j from b),
d as (select id, j, sum(case when x = '[' then 1 else -1 end) over (partition by id order by j) as depth from u),
e as (select id, min(j) as je from d where depth = 0 group by id),
f as (select b.id, substring(sub, 1, (list_sum(list_transform(pieces[1:je], lambda p: length(p))) + je)::bigint) as json
      from b join e using (id)),
l1 as (select rep.id, f.json from rep left join f using (id))"""


@register("L1_extract_json_array", L1_SQL + "\nselect id, json from l1")
def l1_extract_json_array(spark, sf):
    """First '[' to its matching ']' of every cleaned reply (null when unbalanced or absent)."""
    return L.extract_json_array(reply_table(spark, sf)).select("id", "json")


def _rules_sql(items: str) -> str:
    return f"""
objs as (select id, pos, json_extract_string(item, '$.model_name') as model_name,
                json_extract_string(item, '$.package') as package_raw,
                json_extract_string(item, '$.import_path') as path_raw,
                json_extract_string(item, '$.reason') as reason
         from {items}
         where json_type(item) = 'OBJECT' and list_has_all(json_keys(item), ['model_name', 'package', 'reason'])),
reg as (select unnest({[m for m in MODELS]}) as known),
j as (select objs.*, reg.known is not null as is_known from objs left join reg on objs.model_name = reg.known),
pk as (select *, case when instr(package_raw, '.') > 0 then 'scikit-learn' else package_raw end as p1 from j),
sug as (
  select id, pos, model_name,
         case when is_known then (case when lower(trim(p1)) = 'sklearn' then 'scikit-learn' else p1 end)
              when path_raw is null or path_raw = '' then 'scikit-learn'
              when instr(path_raw, '.') = 0 then path_raw
              when split_part(path_raw, '.', 1) = 'sklearn' then 'scikit-learn'
              else split_part(path_raw, '.', 1) end as package,
         case when is_known then imp.path else path_raw end as import_path, reason
  from pk left join (select unnest({[m for m in MODELS]}) as n, unnest({[MODEL_IMPORT_MAP[m][0] + '.' + MODEL_IMPORT_MAP[m][1] for m in MODELS]}) as path) imp on pk.model_name = imp.n
  where is_known or (path_raw is not null and path_raw <> ''))"""


L2_SQL = L1_SQL + r""",
arr as (select id, json::json as a from l1 where json is not null and json_valid(json) and json_type(json::json) = 'ARRAY'),
many as (select id, unnest(generate_series(0, json_array_length(a)::bigint - 1)) as pos, a from arr where json_array_length(a) > 0),
many_items as (select id, pos::integer as pos, json_extract(a, '$[' || pos || ']') as item from many),
c2 as (select id, regexp_replace(regexp_replace(response, '```(?:json)?\s*', '', 'g'), '^\s+|\s+$', '', 'g') as cl from rep),
o as (select id, cl, instr(cl, '{') as fst, length(cl) - instr(reverse(cl), '}') + 1 as lst from c2
      where instr(cl, '[') = 0 and instr(cl, '{') > 0 and instr(cl, '}') > 0),
one as (select id, 0 as pos, substring(cl, fst, lst - fst + 1)::json as item from o
        where lst >= fst and json_valid(substring(cl, fst, lst - fst + 1))),
items as (select * from many_items union all select * from one),""" + _rules_sql("items").rstrip() + """,
filled as (
  select * from sug
  union all
  select id, 0, 'RandomForestRegressor', 'scikit-learn', 'sklearn.ensemble.RandomForestRegressor',
         'Default fallback: random forest works well for most regression tasks'
  from rep where id not in (select id from sug))"""


@register("L2_parse_suggestions", L2_SQL.replace("\nreg as", "\nreg as", 1) + """
select id, pos, model_name, package, import_path, reason from filled""")
def l2_parse_suggestions(spark, sf):
    """Suggestions of every reply: array items, single objects, package rules, default fill."""
    return L.suggestions(reply_table(spark, sf))


@register("L3_single_object", L2_SQL + """
select id, pos, model_name, package, import_path, reason from sug where id in (select id from one)""")
def l3_single_object(spark, sf):
    """Suggestions read from replies holding one JSON object and no '['."""
    r = reply_table(spark, sf)
    objs = L.extract_json_object(r).where(F.col("json_obj").isNotNull()).select("id")
    return L.parse_suggestions(r).join(objs, "id", "left_semi")


def _plan_sql() -> str:
    return L1_SQL + r""",
arr as (select id, json::json as a from l1 where json is not null and json_valid(json) and json_type(json::json) = 'ARRAY'),
many as (select id, unnest(generate_series(0, json_array_length(a)::bigint - 1)) as src, a from arr where json_array_length(a) > 0),
items as (select id, src, json_extract(a, '$[' || src || ']') as item from many),
steps as (
  select id, src, json_extract_string(item, '$.action') as action,
         case when json_extract(item, '$.description') is null then ''
              when json_type(item, '$.description') = 'VARCHAR' then json_extract_string(item, '$.description')
              when json_type(item, '$.description') = 'NULL' then 'None'
              when json_type(item, '$.description') = 'BOOLEAN' then
                   case when json_extract_string(item, '$.description') = 'true' then 'True' else 'False' end
              else json_extract(item, '$.description')::varchar end as description
  from items
  where json_type(item) = 'OBJECT' and json_type(item, '$.action') = 'VARCHAR'
    and json_extract_string(item, '$.action') in ('select_model', 'train', 'evaluate', 'interpret')),
kept as (select id, (row_number() over (partition by id order by src) - 1)::integer as pos, action, description from steps),
dflt as (select * from (values (0, 'select_model', 'Select ML model based on data distribution'),
                               (1, 'train', 'Split data, train model with hyperparameter tuning'),
                               (2, 'evaluate', 'Compute metrics and generate plots on test set'),
                               (3, 'interpret', 'Summarize results and suggest improvements')) v(pos, action, description)),
plan as (select * from kept
         union all
         select rep.id, dflt.pos, dflt.action, dflt.description
         from rep, dflt where rep.id not in (select id from kept))"""


@register("L5_parse_plan", _plan_sql() + "\nselect id, pos, action, description from plan")
def l5_parse_plan(spark, sf):
    """Plan steps of every reply: valid actions only, description as text, default plan otherwise."""
    return L.parse_plan(reply_table(spark, sf))


@register("L8_plan_descriptions", _plan_sql() + "\nselect id, pos, coalesce(description, action) as step from plan")
def l8_plan_descriptions(spark, sf):
    """Ordered step texts of every reply's plan."""
    return L.plan_descriptions(L.parse_plan(reply_table(spark, sf)))
