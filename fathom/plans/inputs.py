"""Derived inputs shared by the registered queries and their SQL oracles.

The driver tables hold no nulls and no text numbers, so the null and
coercion ops get them derived from existing values, by the same rule in
Spark and in SQL. These helpers only shape rows; no op's work is done here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.plans.catalog import table

# lineitem with nulls where the row's own values say so
LINEITEM_NULLS_SQL = """
select l_orderkey, l_linenumber,
       case when l_quantity > 45 then null else l_quantity end as l_quantity,
       l_extendedprice, l_discount, l_tax,
       case when l_tax = 0 then null else l_returnflag end as l_returnflag,
       l_linestatus
from lineitem"""


def lineitem_nulls(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") > 45, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax",
        F.when(F.col("l_tax") == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus")


# orders priority with a null class where the price is low
ORDERS_CLASS_SQL = """
select o_orderkey, case when o_totalprice < 20000 then null else o_orderpriority end as o_orderpriority
from orders"""


def orders_class(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_totalprice") < 20000, F.lit(None))
                    .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


# events value as text, with junk in place of large values
EVENTS_TEXT_SQL = """
select event_id, case when value > 300 then 'n/a' else cast(value as varchar) end as value_text
from events"""


def events_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.when(F.col("value") > 300, F.lit("n/a"))
                    .otherwise(F.col("value").cast("string")).alias("value_text"))


# classification table: document features and the quality label
DOCS_SQL = """
select l.doc_id, d.n_chars, d.lang, d.source, l.quality
from labels l join documents d on l.doc_id = d.doc_id"""


def docs(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(d, "doc_id").select("doc_id", "n_chars", "lang", "source", "quality")


# regression table: line items with part attributes
LINEPART_SQL = """
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag,
       l.l_linestatus, p.p_size, p.p_retailprice, l.l_extendedprice
from lineitem l join part p on l.l_partkey = p.p_partkey"""


def linepart(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                             "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                                             "l_extendedprice")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    return li.join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_size",
                                         "p_retailprice", "l_extendedprice")


LINEPART_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_size",
                     "p_retailprice"]
DOCS_FEATURES = ["n_chars", "lang", "source"]
