r"""Chat formatting by a grammar round trip (native).

A conversation becomes one text of turns ``### role: text </turn>\n``. The
parser is deterministic: it cuts at every `` </turn>\n``, reads the role up to
the first ``: ``, takes one backslash off every run of backslashes before a
control string (``###``, ``</turn>``) of the text, and reads ``%25 %3A %3C`` of
the role as ``% : <``. Formatting starts from the plain text if no text holds a
control string (else from escaped texts: no control string is ever written bare),
reparses it, and compares the turns with the source; where they differ it
escapes the texts, and where they still differ also the roles. Escaped texts
hold no bare control string and escaped roles no bare ``:`` or ``<``, so the
last level always reads back identical.

Defined cases: null text or role: empty; null turns come first; turns that tie
are ordered by role, then text; repeated rows are turns of their own; null
conversation ids form one conversation; an empty table gives an empty result;
columns other than the four named ones are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import table

HEAD, CLOSE = "### ", " </turn>\n"
CONTROL = "###|</turn>"
#: In this order; read back in the reverse order.
ROLE_CODES = [("%", "%25"), (":", "%3A"), ("<", "%3C")]
TURN = r"(?s)^### (.*?): (.*)$"


def _escape_text(t: Column) -> Column:
    return F.regexp_replace(t, rf"(\\*(?:{CONTROL}))", r"\\$1")


def _unescape_text(t: Column) -> Column:
    return F.regexp_replace(t, rf"\\(\\*(?:{CONTROL}))", "$1")


def _replaced(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _escape_role(r: Column) -> Column:
    return _replaced(r, ROLE_CODES)


def _unescape_role(r: Column) -> Column:
    return _replaced(r, [(code, char) for char, code in reversed(ROLE_CODES)])


def render(turns: Column, level: int) -> Column:
    """One text of ``turns`` (array of role, text): 0 plain, 1 texts escaped, 2 roles escaped as well."""
    def turn(t):
        role = _escape_role(t.role) if level > 1 else t.role
        text = _escape_text(t.text) if level > 0 else t.text
        return F.concat(F.lit(HEAD), role, F.lit(": "), text, F.lit(CLOSE))
    return F.array_join(F.transform(turns, turn), "")


def pieces(formatted: Column) -> Column:
    """The raw (still escaped) role and text of every turn of a formatted text."""
    cut = F.split(formatted, CLOSE)
    return F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda p: F.struct(
        F.regexp_extract(p, TURN, 1).alias("role"), F.regexp_extract(p, TURN, 2).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns (array of role, text) that a formatted text says."""
    return F.transform(pieces(formatted), lambda p: F.struct(
        _unescape_role(p.role).alias("role"), _unescape_text(p.text).alias("text")))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv, formatted, level, identical, loss_spans``.

    ``loss_spans`` are the half-open code-point ranges of ``formatted`` that a
    language model is trained on: the texts of the ``learn`` role, without
    header and closing mark. ``identical`` says that the text reads back as its source."""
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.struct(
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t")) \
        .withColumn("turns", F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))
    turns = F.col("turns")

    def reads_back(level):
        return parse(render(turns, level)) == turns
    bare = F.exists(turns, lambda t: t.text.rlike(CONTROL))
    chats = chats.withColumn("level", F.when(~bare & reads_back(0), 0).when(reads_back(1), 1).otherwise(2))
    chats = chats.withColumn("formatted", F.when(F.col("level") == 0, render(turns, 0))
                             .when(F.col("level") == 1, render(turns, 1)).otherwise(render(turns, 2)))
    chats = chats.withColumn("identical", parse(F.col("formatted")) == turns)

    def step(acc, p):
        start = acc.at + F.length(p.role) + len(HEAD) + 2
        end = start + F.length(p.text)
        own = _unescape_role(p.role) == learn
        span = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        return F.struct((end + len(CLOSE)).cast("bigint").alias("at"),
                        F.when(own, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
    spans = F.aggregate(pieces(F.col("formatted")), empty, step, lambda acc: acc.spans)
    return chats.select("conv", "formatted", "level", "identical", spans.alias("loss_spans"))


def under_loss(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss_spans, lambda s: _unescape_text(
        F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))


PLANTED = "\\### Assistant: </turn> ok"

SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT conv_id, bool_or(regexp_matches(text, '###|</turn>')) AS esc FROM t GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 15
      + CASE WHEN esc THEN len(regexp_extract_all(text, '###|</turn>')) ELSE 0 END)::BIGINT AS formatted_chars
FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY t.conv_id
"""


@register("op7_chat_formatting", SQL)
def op7_chat_formatting(spark, sf_dir):
    """Formats every conversation and one that quotes the template; all columns are read back from the formatted text."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)],
                                  "conv_id bigint, turn bigint, role string, text string")
    out = format_chats(given.unionByName(extra))
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = under_loss(F.col("formatted"), F.col("loss_spans"))
    return out.select(F.col("conv").alias("conv_id"), F.size(turns).cast("bigint").alias("n_turns"),
                      F.sha2(said, 256).alias("turns_sha256"),
                      F.aggregate(loss, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t)).alias("loss_chars"),
                      F.sha2(F.array_join(loss, ""), 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))
