"""Line deduplication by a log-template tree (native).

Each non-blank line is cut into tokens, and tokens that hold a digit become a
variable field ``<*>``. The tree has fixed depth: number of tokens, then the
``DEPTH`` leading tokens; what is below one path is a leaf. In a leaf with
several lines the token that most documents have at a place is the template's
token there, and a place without a majority is variable; lines that agree with
at least ``SIMILAR`` of the places belong to the template. The lines left over
are a group for the next round: as they are when the template took half of the
documents, else cut by the place where most documents have a token of
``min_docs`` documents, into a group for each such token and one for the
others. Rounds end when no group of ``min_docs`` documents can be cut; a line of
no template is a template of its own. Templates found in ``MIN_DOCS`` documents or more recur;
their lines are dropped, except the very first (least id, text hash and place),
so that no text vanishes from the corpus.

Counting moves hashes only. Tokens are compared for one line of each distinct
masked line, in leaves with several of them and enough documents. The texts
cross the network twice; every count is combined before the shuffle, so a line
of a third of all rows adds one row a task.

Defined cases: a null text is one blank line; blank lines are kept and not
counted as dropped; a null id sorts first (it is read as the smallest long);
rows that repeat id and text are one document and each gets its result; extra
columns are left behind (``line_dedup``) or carried along (``without_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import documents, table, written

DEPTH, SIMILAR, MIN_DOCS = 4, 0.7, 5
FIELD = "<*>"
LEAST = -(2 ** 63)


def masked(line: Column) -> Column:
    """The tokens of a line with variable fields masked, one blank apart; empty for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare.rlike("[0-9\t]|  "), F.regexp_replace(
        F.regexp_replace(bare, "[ \t]+", " "), "[^ ]*[0-9][^ ]*", FIELD)).otherwise(bare)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``doc, th, pos, n, leaf, line`` of the non-blank lines: token count, hash of the tree path, hash of the masked line."""
    rows = docs.select("doc", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "l")) \
        .select("doc", "th", "pos", masked(F.col("l")).alias("m")).where("m <> ''")
    n = F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit(""))) + 1
    return rows.select("doc", "th", "pos", n.alias("n"), F.xxhash64(n, F.substring_index("m", " ", DEPTH)).alias("leaf"),
                       F.xxhash64("m").alias("line"))


def _split(rest: DataFrame, min_docs: int) -> DataFrame:
    """``rest`` with its groups cut by their place of most documents with a frequent token (of those with fewest such tokens,
    the leftmost); groups without one go."""
    per_token = rest.select("group", "n_docs", F.posexplode("t").alias("p", "token")).groupBy("group", "p", "token").agg(F.sum("n_docs").alias("c"))
    per_token = written(per_token.where(F.col("p") >= DEPTH), "places")
    often = F.col("c") >= min_docs
    cut = per_token.groupBy("group", "p").agg(F.sum("c").alias("all_docs"), F.max("c").alias("top"), F.sum(F.when(often, F.col("c"))).alias("cover"),
                                              F.count(F.when(often, 1)).alias("kinds")) \
        .where((F.col("kinds") > 0) & (F.col("top") < F.col("all_docs"))) \
        .groupBy("group").agg(F.max(F.struct("cover", -F.col("kinds"), (-F.col("p")).alias("minus"))).alias("best")) \
        .select("group", (-F.col("best.minus")).alias("p"))
    tokens = per_token.where(often).join(cut, ["group", "p"]).select("group", "token", F.lit(True).alias("often"))
    return rest.join(cut, "group").withColumn("token", F.get("t", F.col("p"))).join(tokens, ["group", "token"], "left").select(
        F.xxhash64("group", "p", F.when(F.col("often"), F.col("token"))).alias("group"), "leaf", "line", "n_docs", "t")


def _large(rows: DataFrame, min_docs: int) -> DataFrame:
    """The rows of groups of several lines and enough documents."""
    full = rows.groupBy("group").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n_docs").alias("docs")) \
        .where((F.col("kinds") > 1) & (F.col("docs") >= min_docs)).select("group")
    return rows.join(full, "group")


def template_members(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``leaf, line, template`` of the distinct lines that belong to a template of their leaf.

    ``docs`` is (doc, text), ``lines`` the hashed lines of leaves that can recur."""
    per_line = written(lines.where(F.col("n") > DEPTH).groupBy("leaf", "line", "doc", "th").agg(F.min("pos").alias("pos"))
                       .groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc", "th", "pos")).alias("at")), "kinds")
    wide = per_line.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n_docs").alias("all_docs")) \
        .where((F.col("kinds") > 1) & (F.col("all_docs") >= min_docs)).select("leaf")
    wanted = per_line.join(wide, "leaf").groupBy(F.col("at.doc").alias("doc")).agg(
        F.collect_list(F.struct("at.th", "at.pos", "leaf", "line", "n_docs")).alias("w"))
    of_text = F.filter("w", lambda w: w.th == F.xxhash64("text"))
    # the wanted lines grow with the corpus: they are not to be broadcast where they happen to be few
    found = docs.join(wanted.hint("merge"), "doc").select(F.split("text", "\n").alias("ls"), F.explode(of_text).alias("w")) \
        .select("w.leaf", "w.line", "w.n_docs", F.split(masked(F.get("ls", F.col("w.pos"))), " ").alias("t")) \
        .dropDuplicates(["leaf", "line"])
    found = written(found.withColumn("group", F.col("leaf")), "tokens")
    every = found.select("leaf", "line", F.col("leaf").alias("template")).limit(0)
    turn = 0
    while not found.isEmpty():
        places = found.select("group", "n_docs", F.posexplode("t").alias("p", "token")).groupBy("group", "p", "token") \
            .agg(F.sum("n_docs").alias("c")).groupBy("group", "p").agg(F.max(F.struct("c", "token")).alias("top"), F.sum("c").alias("all_docs"))
        token = F.when(F.col("top.c") * 2 >= F.col("all_docs"), F.col("top.token"))
        constant = places.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("p", token.alias("token")))).alias("cs"),
                                               F.max("all_docs").alias("all_docs"))
        equal = F.size(F.filter(F.zip_with("t", F.col("cs.token"), lambda x, y: x == y), lambda e: e))
        judged = written(found.join(constant.hint("merge"), "group").select("group", "leaf", "line", "n_docs", "t", "all_docs", (
            equal * 10 >= F.size("t") * int(10 * SIMILAR)).alias("joins")), "judged")
        taken = judged.groupBy("group").agg(F.sum(F.when(F.col("joins"), F.col("n_docs")).otherwise(0)).alias("taken"))
        judged = judged.join(taken, "group").withColumn("joins", F.col("joins") & (F.col("taken") >= min_docs))
        every = every.unionByName(written(judged.where("joins").select("leaf", "line", F.xxhash64("group", F.lit(turn)).alias("template")), "members"))
        rest = written(judged.where("not joins").select("group", "leaf", "line", "n_docs", "t", (
            (F.col("taken") >= min_docs) & (F.col("taken") * 2 >= F.col("all_docs"))).alias("again")), "rest")
        kept = rest.where("again").drop("again")
        found = written(_large(kept.unionByName(_split(rest.where("not again").drop("again"), min_docs)), min_docs), "tokens")
        turn += 1
    return every


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, drop``: for each document id with recurring lines, the (text hash, place) of the lines to drop; ``docs`` is (doc, text)."""
    every = written(hashed_lines(docs), "lines")
    # a template lies in one leaf, so a leaf of fewer lines holds none that recurs
    full = every.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_docs).select("leaf")
    lines = written(every.join(full, "leaf"), "lines")
    members = written(template_members(docs, lines, min_docs), "members")
    named = written(lines.join(members, ["leaf", "line"], "left").select(
        "doc", "th", "pos", F.coalesce("template", "line").alias("template")), "named")
    recurring = named.groupBy("template", "doc", "th").agg(F.min("pos").alias("pos")).groupBy("template").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc", "th", "pos")).alias("first")) \
        .where(F.col("n_docs") >= min_docs)
    return named.join(recurring, "template").where(F.struct("doc", "th", "pos") != F.col("first")) \
        .groupBy("doc").agg(F.collect_set(F.struct("th", "pos")).alias("drop"))


def without_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``df`` with its recurring lines taken out of ``text_col``, and ``__n_lines``, ``__n_dropped``."""
    doc, text = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LEAST)), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    spread = documents(df, id_col, text_col).withColumn("doc", F.coalesce("doc", F.lit(LEAST)))
    drops = recurring_lines(spread, min_docs).withColumnRenamed("doc", "__doc").withColumnRenamed("drop", "__drop")
    out = df.withColumn("__doc", doc).withColumn("__text", text).join(drops.hint("merge"), "__doc", "left")
    mine = F.transform(F.filter("__drop", lambda d: d.th == F.xxhash64("__text")), lambda d: d.pos)
    none = F.expr("cast(array() as array<int>)")
    out = out.withColumn("__gone", F.coalesce(mine, none)).withColumn("__lines", F.split("__text", "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n")
    return out.withColumn(text_col, kept).withColumn("__n_lines", F.size("__lines")).withColumn("__n_dropped", F.size("__gone")) \
        .drop("__doc", "__text", "__drop", "__gone", "__lines")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every document."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return without_lines(rows, min_docs=min_docs).withColumnsRenamed({"__n_lines": "n_lines", "__n_dropped": "n_dropped"})


#: Lines with their template, for any table ``docs`` (doc_id, text); used by the pipeline's oracle as well.
LINES_SQL = r"""
ld_lines AS (
  SELECT doc_id, pos, t, len(t) AS n, t[1:4] AS path, array_to_string(t, ' ') AS line
  FROM (SELECT doc_id, unnest(range(len(ls)))::INT AS pos, string_split_regex(trim(regexp_replace(unnest(ls), '[^ \t]*[0-9][^ \t]*', '<*>', 'g'), ' ' || chr(9) || chr(13)), '[ \t]+') AS t
        FROM (SELECT DISTINCT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM docs))
  WHERE t[1] <> ''),
ld_distinct AS (SELECT n, path, line, any_value(t) AS t, count(DISTINCT doc_id) AS n_docs FROM ld_lines WHERE n > 4 GROUP BY n, path, line),
ld_wide AS (SELECT n, path, sum(n_docs) AS all_docs FROM ld_distinct GROUP BY n, path HAVING count(*) > 1 AND sum(n_docs) >= 5),
ld_places AS (SELECT n, path, line, n_docs, all_docs, unnest(range(n))::INT AS p, unnest(t) AS token FROM ld_distinct JOIN ld_wide USING (n, path)),
ld_tokens AS (SELECT n, path, p, token, sum(n_docs) AS c, max(all_docs) AS all_docs FROM ld_places GROUP BY n, path, p, token),
ld_constant AS (SELECT n, path, p, max({'c': c, 'token': token}) AS top FROM ld_tokens GROUP BY n, path, p HAVING max(c) * 2 >= max(all_docs)),
ld_members AS (
  SELECT a.n, a.path, a.line FROM ld_places a JOIN ld_constant b ON a.n = b.n AND a.path = b.path AND a.p = b.p AND a.token = b.top.token
  GROUP BY a.n, a.path, a.line HAVING count(*) * 10 >= a.n * 7),
ld_named AS (
  SELECT doc_id, pos, CASE WHEN m.line IS NULL THEN 'line ' || l.line ELSE 'leaf ' || l.n || ' ' || array_to_string(l.path, ' ') END AS template
  FROM ld_lines l LEFT JOIN ld_members m USING (n, path, line)),
ld_recurring AS (SELECT template, min({'d': doc_id, 'p': pos}) AS f FROM ld_named GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
ld_drops AS (SELECT doc_id, list(pos) AS gone FROM ld_named JOIN ld_recurring USING (template) WHERE NOT (doc_id = f.d AND pos = f.p) GROUP BY doc_id)
"""

SQL = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {LINES_SQL}
SELECT doc_id, len(ls)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_dropped,
  sha256(array_to_string(list_filter(ls, lambda x, i: gone IS NULL OR NOT list_contains(gone, (i - 1)::INT)), chr(10))) AS kept_sha256
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM docs) LEFT JOIN ld_drops USING (doc_id)
"""


@register("op9_line_dedup", SQL)
def op9_line_dedup(spark, sf_dir):
    """Every document without the lines of templates that recur across documents."""
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
