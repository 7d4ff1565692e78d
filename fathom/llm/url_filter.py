"""URL filters as a temporal list join (native).

Lists are tables of dated entries: from ``dated`` on an entry (list, kind, value)
is active with a verdict, or inactive. Consecutive entries of one value become
validity intervals [start, until): a later entry of the list ends the earlier one, also
if only its verdict differs. An as-of join evaluates every capture
against the entries that were active when it was fetched. A capture is looked
up under the keys its URL can match: ``domain`` (the host and every parent
domain), ``host`` (the host itself) and ``prefix`` (host plus leading path
segments). Among the active matches the most specific kind and longest value
decides (prefix, host, domain), a block before an allow.

The lookup is an equi-join on (kind, value) with the interval as a further
condition. Captures that share URL and fetch date are evaluated once, so a hot
page adds one row; keys longer than any entry of the lists cannot match and
are not made.

Defined cases: a null or hostless URL has no keys and a null fetch date lies in
no interval: not blocked, no active entries. Of entries of one value and date an
active one counts before an inactive one and a block before an allow; a null date means "always before"; repeated
list rows count once; repeated captures each get a row. Null list, kind or
value: the entry is left out; null verdict: block. Empty tables are allowed;
extra columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import table

URL = r"(?i)^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
#: Kinds from least to most specific.
KINDS = ["domain", "host", "prefix"]
ALWAYS = "0001-01-01"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, URL, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, kind, value, verdict, start, until`` of the times an entry was active; an open end is null."""
    entry, verdict = ["list", "kind", "value"], F.coalesce("verdict", F.lit("block"))
    changes = entries.select(*entry, verdict.alias("verdict"), (verdict == "block").alias("blocks"),
                             F.coalesce(F.col("dated").cast("date"), F.lit(ALWAYS).cast("date")).alias("dated"),
                             F.coalesce("active", F.lit(False)).alias("active")) \
        .where("list is not null and kind is not null and value is not null") \
        .groupBy(*entry, "dated").agg(F.max(F.struct("active", "blocks", "verdict")).alias("e")).select(*entry, "dated", "e.active", "e.verdict")
    after = F.lead("dated").over(Window.partitionBy(*entry).orderBy("dated"))
    return changes.withColumn("until", after).where("active").select(*entry, "verdict", F.col("dated").alias("start"), "until")


def _keys(host: Column, path: Column, labels: int, segments: int) -> Column:
    """The (kind, value) pairs that can match, up to the longest names that the lists hold."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, labels)))), lambda k: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(parts, n - k + 1, k), ".").alias("value")))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps), F.lit(segments))), lambda k: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.when(k > 0, F.lit("/")).otherwise(F.lit("")),
                                                F.array_join(F.slice(steps, F.lit(1), k), "/")).alias("value")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.when(host != "", F.concat(domains, own, prefixes))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
               fetched_col: str = "fetched") -> DataFrame:
    """One row per capture: ``id, url, fetched, blocked, n_active, decided_by``.

    ``decided_by`` is the deciding entry as ``list:kind:value``, null without any."""
    active = intervals(entries)
    widest = active.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 1)).alias("segments")).first()
    rows = captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                           F.col(f"`{fetched_col}`").cast("date").alias("fetched"))
    seen = rows.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    keyed = seen.select("url", "fetched", F.explode(_keys(
        host_of(F.col("url")), path_of(F.col("url")), widest.labels or 0, widest.segments or 0)).alias("k")) \
        .select("url", "fetched", "k.kind", "k.value")
    found = keyed.join(active, ["kind", "value"]).where(
        (F.col("start") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = F.struct(rank, F.length("value"), (F.col("verdict") == "block").cast("int"),
                     F.concat_ws(":", "list", "kind", "value"))
    verdicts = found.groupBy("url", "fetched").agg(
        F.count(F.lit(1)).alias("n_active"), F.max(order).alias("top"))
    top = verdicts.select("url", "fetched", "n_active", (F.col("top")["col3"] == 1).alias("blocked"),
                          F.col("top")["col4"].alias("decided_by"))
    return rows.join(top, ["url", "fetched"], "left").select(
        "id", "url", "fetched", F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), "decided_by")


def _digits(h, start, length):
    return F.conv(F.substring(h, start, length), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Stand-in input: the pages with a fetch date drawn from their id."""
    day = _digits(F.md5(F.col("page_id").cast("string")), 1, 4) % 730
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def lists_of(pages: DataFrame) -> DataFrame:
    """Stand-in input: dated entries about some of the hosts, domains and first path segments of the pages."""
    named = pages.select(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("h"),
                         F.regexp_extract("url", "^[a-z]+://[^/?#:]+(?::[0-9]+)?/([^/?#]+)", 1).alias("s")).where("h <> ''")
    values = named.select(F.lit("host").alias("kind"), F.col("h").alias("value")).unionByName(
        named.select(F.lit("domain").alias("kind"), F.regexp_replace("h", r"^[^.]*\.", "").alias("value"))).unionByName(
        named.where("s <> ''").select(F.lit("prefix").alias("kind"), F.concat_ws("/", "h", "s").alias("value"))).distinct()
    h = F.md5(F.concat_ws(":", "kind", "value"))
    drawn = values.withColumn("h", h).where(_digits(F.col("h"), 1, 1) < 6)
    first = F.date_add(F.lit("2024-01-01").cast("date"), _digits(F.col("h"), 9, 2))
    second = F.date_add(first, _digits(F.col("h"), 11, 2) + 1)
    third = F.date_add(second, _digits(F.col("h"), 13, 2) + 1)
    event = lambda d, on: F.struct(d.alias("dated"), F.lit(on).alias("active"))
    none = F.expr("cast(array() as array<struct<dated:date,active:boolean>>)")
    events = F.concat(F.array(event(first, True)),
                      F.when(_digits(F.col("h"), 2, 1) < 10, F.array(event(second, False))).otherwise(none),
                      F.when(_digits(F.col("h"), 2, 1) < 5, F.array(event(third, True))).otherwise(none))
    return drawn.select(F.when(_digits(F.col("h"), 3, 1) < 8, "ads").otherwise("spam").alias("list"), "kind", "value",
                        F.when((F.col("kind") == "prefix") & (_digits(F.col("h"), 4, 1) < 8), "allow").otherwise("block").alias("verdict"),
                        F.explode(events).alias("e")).select("list", "kind", "value", "verdict", "e.dated", "e.active")


SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT % 730) AS fetched,
    lower(regexp_extract(url, '(?i)^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) AS host,
    regexp_extract(url, '(?i)^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2) AS path FROM pages),
named AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h,
                 regexp_extract(url, '^[a-z]+://[^/?#:]+(?::[0-9]+)?/([^/?#]+)', 1) AS s FROM pages),
vals AS (SELECT 'host' AS kind, h AS value FROM named WHERE h <> '' UNION
         SELECT 'domain', regexp_replace(h, '^[^.]*\.', '') FROM named WHERE h <> '' UNION
         SELECT 'prefix', h || '/' || s FROM named WHERE h <> '' AND s <> ''),
x AS (SELECT kind, value, md5(kind || ':' || value) AS h FROM vals),
y AS (SELECT *, DATE '2024-01-01' + ('0x' || substr(h, 9, 2))::INT AS d1 FROM x WHERE ('0x' || substr(h, 1, 1))::INT < 6),
z AS (SELECT *, d1 + (('0x' || substr(h, 11, 2))::INT + 1) AS d2, ('0x' || substr(h, 2, 1))::INT AS n FROM y),
active AS (
  SELECT *, d1 AS start, CASE WHEN n < 10 THEN d2 END AS until FROM z
  UNION ALL SELECT *, d2 + (('0x' || substr(h, 13, 2))::INT + 1), NULL FROM z WHERE n < 5),
entries AS (SELECT kind, value, start, until, CASE WHEN ('0x' || substr(h, 3, 1))::INT < 8 THEN 'ads' ELSE 'spam' END AS list,
  CASE WHEN kind = 'prefix' AND ('0x' || substr(h, 4, 1))::INT < 8 THEN 'allow' ELSE 'block' END AS verdict FROM active),
hits AS (
  SELECT page_id, e.*, CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS rank
  FROM captures c JOIN entries e ON start <= fetched AND (until IS NULL OR fetched < until) AND (
    (kind = 'host' AND host = value) OR (kind = 'domain' AND (host = value OR ends_with(host, '.' || value)))
    OR (kind = 'prefix' AND starts_with(rtrim(host || path, '/') || '/', value || '/')))),
tops AS (
  SELECT page_id, count(*) AS n_active, max({'a': rank, 'b': length(value), 'c': (verdict = 'block')::INT, 'd': list || ':' || kind || ':' || value}) AS top
  FROM hits GROUP BY page_id)
SELECT c.page_id, c.fetched::VARCHAR AS fetched, coalesce(top.c = 1, false) AS blocked, coalesce(n_active, 0)::BIGINT AS n_active, top.d AS decided_by
FROM captures c LEFT JOIN tops t ON c.page_id = t.page_id
"""


@register("op2_url_filter", SQL)
def op2_url_filter(spark, sf_dir):
    """Every page, at a fetch date drawn from its id, against dated lists about hosts, domains and paths of the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(captures_of(pages), lists_of(pages)).select(
        F.col("id").alias("page_id"), F.col("fetched").cast("string").alias("fetched"), "blocked", "n_active", "decided_by")
