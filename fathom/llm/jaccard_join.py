"""N-gram Jaccard join by chosen paths.

Sets are the word 5-grams of the distinct texts. A set is embedded as
``COORDS`` MinHash values. In each run the sets start in one node; a node
chooses one or two of the coordinates (1 / similarity on average) by a hash
of its own, and a set goes on to the child named by its value there. A node
of at most ``LIMIT`` sets is a leaf, and its sets' sketches are compared all
with all. Larger nodes are split again, up to ``LEVELS`` times; sets that
share so many values are taken as candidates of the node's first set. The
number of runs follows from the target recall and the survival of a pair of
just the wanted similarity down to the last level.

Candidate pairs are only used to put sets into groups (connected components),
so no list of pairs is ever made. Within a group every pair is compared
exactly, in blocks of at most ``BLOCK`` sets a side, and each set's links are
counted there; the links' components are the classes.

Defined cases: a text of fewer than five words has one shingle, all its
words (texts without words, null ones included, are alike); equal texts are
compared once and linked to each other; rows that repeat id and text are
documents of their own here, links included; a null id is the least;
an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fathom.llm import wordhash as W
from fathom.llm.catalog import register
from fathom.llm.common import SHINGLE, SIMILARITY, complete_groups, documents, ship, table, written
from fathom.llm.components import components

COORDS, LIMIT, LEVELS, BLOCK = 64, 200, 5, 256
RECALL = 0.999
#: A sketch may fall short of the wanted similarity by so many standard errors.
SLACK = 4.5


def runs_for(recall: float, similarity: float, levels: int) -> int:
    """Runs after which a pair of this similarity has met in a node of the last level with probability ``recall``."""
    lost, more = 0.0, 1 / similarity - 1
    for _ in range(levels):
        s = 1 - similarity + similarity * lost
        lost = (1 - more) * s + more * s * s
    return math.ceil(math.log(1 - recall) / math.log(lost)) if lost else 1


def _multipliers() -> np.ndarray:
    return W.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _chosen(node: np.ndarray, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which rows, coordinate) of the first and of the second choice of each row's node."""
    h = W.mix(node ^ np.uint64(0xA0761D6478BD642F))
    first = (h % np.uint64(COORDS)).astype(np.int64)
    second = ((h >> np.uint64(32)) % np.uint64(COORDS)).astype(np.int64)
    twice = (W.mix(h) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 < 1 / similarity - 1
    rows = np.arange(len(node))
    return [(rows, first), (rows[twice & (first != second)], second[twice & (first != second)])]


def _child(node, coordinate, value):
    return W.mix(W.mix(node + coordinate.astype(np.uint64) * np.uint64(W.BASE)) ^ value)


def _sketch_rows(n_runs: int, similarity: float):
    """(tid, text) -> size of the shingle set, sketch (low 16 bits of each MinHash), children of the runs' roots."""
    def work(batches):
        a = _multipliers()
        roots = W.mix(np.arange(1, n_runs + 1, dtype=np.uint64))
        steps = [(roots[r], int(c)) for rows, at in _chosen(roots, similarity) for r, c in zip(rows, at)] if n_runs else []
        for b in batches:
            texts = b["text"].tolist()
            for i, j in W.chunks(texts):
                sets = W.shingles(texts[i:j], SHINGLE)
                sizes = np.array([len(s) for s in sets])
                flat, first = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1]))
                least = np.stack([np.minimum.reduceat(flat * m, first) for m in a], axis=1)
                full = W.mix(least)
                low = full.astype(np.uint16)
                kids = np.stack([_child(np.full(len(sets), root), np.full(len(sets), c), full[:, c]) for root, c in steps], axis=1)
                yield pd.DataFrame({"tid": b["tid"].iloc[i:j].to_numpy(), "size": sizes, "sketch": [x.tobytes() for x in low],
                                    "nodes": list(kids.view(np.int64))})
    return work


def _split_rows(similarity: float):
    """(node, tid, sketch) -> the same one level below."""
    def work(batches):
        for b in batches:
            node = b["node"].to_numpy().view(np.uint64)
            low = np.frombuffer(b"".join(b["sketch"]), np.uint16).reshape(len(b), COORDS)
            for rows, at in _chosen(node, similarity):
                value = low[rows, at].astype(np.uint64)
                yield pd.DataFrame({"node": _child(node[rows], at, value).view(np.int64), "tid": b["tid"].to_numpy()[rows],
                                    "sketch": b["sketch"].to_numpy()[rows]})
    return work


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component of a symmetric matrix."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        lower = np.where(linked, label[None, :], len(label)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _leaf_edges(similarity: float):
    """(node, tid, sketch) sorted by node -> edges (a, b) that connect the sets whose sketches are alike."""
    least = COORDS * similarity - SLACK * math.sqrt(COORDS * similarity * (1 - similarity))

    def work(batches):
        for b in complete_groups(batches, ["node"]):
            node = b["node"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
            low = np.frombuffer(b"".join(b["sketch"]), np.uint16).reshape(len(b), COORDS)
            tid = b["tid"].to_numpy()
            one, other = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                x = low[s:e]
                if e - s == 2:
                    if (x[0] == x[1]).sum() >= least:
                        one.append(tid[s])
                        other.append(tid[s + 1])
                    continue
                label = _labels(np.stack([(x == row).sum(axis=1) for row in x]) >= least)
                for k in np.flatnonzero(label != np.arange(e - s)).tolist():
                    one.append(tid[s + k])
                    other.append(tid[s + label[k]])
            yield pd.DataFrame({"a": one, "b": other})
    return work


def candidate_edges(sketches: DataFrame, similarity: float = SIMILARITY, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """Edges (a, b) whose components hold every similar pair, but for one in 1 / (1 - recall)."""
    small = sketches.select("tid", "sketch")
    nodes = sketches.select("tid", F.explode("nodes").alias("node"))
    found, rows = [], None
    for level in range(1, levels + 1):
        if rows is not None:
            nodes = written(rows.mapInPandas(_split_rows(similarity), "node bigint, tid binary, sketch binary"), "nodes")
        counted = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("least")).where("n > 1")
        held = nodes.join(counted, "node")
        held = written(held if rows is not None else held.join(small, "tid"), "held")
        leaves = held.where(F.col("n") <= limit).select("node", "tid", "sketch")
        found.append(leaves.repartition("node").sortWithinPartitions("node").mapInPandas(_leaf_edges(similarity), "a binary, b binary"))
        large = held.where(F.col("n") > limit)
        if level == levels:
            found.append(large.select(F.col("tid").alias("a"), F.col("least").alias("b")))
        rows = large.select("node", "tid", "sketch")
        if rows.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _blocked(block: int):
    """(comp, m, tid, copies, text) -> a row of the set for each pair of blocks of its group that it takes part in."""
    def work(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in W.chunks(texts):
                part = b.iloc[i:j]
                sets = [s.tobytes() for s in W.shingles(texts[i:j], SHINGLE)]
                n = -(-part["m"].to_numpy() // block)
                own = np.array([int.from_bytes(t[:6], "big") for t in part["tid"]]) % n
                at = np.repeat(np.arange(len(part)), n)
                partner = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                mine = own[at]
                yield pd.DataFrame({"comp": part["comp"].to_numpy()[at], "i": np.minimum(mine, partner), "j": np.maximum(mine, partner),
                                    "mine": mine, "tid": part["tid"].to_numpy()[at], "copies": part["copies"].to_numpy()[at],
                                    "set": np.array(sets, object)[at]})
    return work


def _linked(similarity: float):
    """Sets sorted by pair of blocks -> for each set its links to other texts there, their documents, and a label."""
    up, down = Fraction(similarity).limit_denominator(1000).as_integer_ratio()

    def work(batches):
        for b in complete_groups(batches, ["comp", "i", "j"]):
            for _, g in b.groupby(["comp", "i", "j"], sort=False):
                g = g.drop_duplicates("tid")
                sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
                sizes = np.array([len(s) for s in sets])
                first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                values, place = np.unique(np.concatenate(sets), return_inverse=True)
                mine, i, j = g["mine"].to_numpy(), g["i"].iloc[0], g["j"].iloc[0]
                linked = np.zeros((len(g), len(g)), bool)
                has = np.zeros(len(values), np.int64)
                for k in range(len(g)):
                    if i != j and mine[k] != i:
                        continue
                    at = place[first[k]:first[k] + sizes[k]]
                    has[at] = 1
                    shared = np.add.reduceat(has[place], first)
                    has[at] = 0
                    # shared / (sum of sizes - shared) >= up / down
                    linked[k] = shared * (up + down) >= up * (sizes + sizes[k])
                    linked[k] &= (mine == j)
                linked |= linked.T
                np.fill_diagonal(linked, False)
                yield pd.DataFrame({"tid": g["tid"].to_numpy(), "texts": linked.sum(axis=1),
                                    "docs": linked.astype(np.int64) @ g["copies"].to_numpy().astype(np.int64),
                                    "label": g["tid"].to_numpy()[_labels(linked)]})
    return work


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    recall: float = RECALL, limit: int = LIMIT, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """``doc, tid, class_id, class_tid, n_links``: one row per row of ``df``.

    ``tid`` names the text, ``class_id`` is the least id among the documents
    that links connect it with and ``class_tid`` its text; ``n_links`` counts the other documents of
    similarity ``similarity`` or more, those of equal text included."""
    docs = documents(df, id_col, text_col).withColumn("tid", F.unhex(F.md5("text")))
    texts = written(docs.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc")).alias("rep")), "texts")
    sketch = docs.select("tid", "text").mapInPandas(_sketch_rows(runs_for(recall, similarity, levels), similarity),
                                                    "tid binary, size int, sketch binary, nodes array<bigint>")
    sketches = written(sketch.dropDuplicates(["tid"]), "sketches")
    groups = components(candidate_edges(sketches, similarity, limit, levels))
    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    member = written(groups.join(sizes, "comp").withColumnRenamed("node", "tid").join(texts, "tid"), "members")
    # members grow with the corpus: they are not to be broadcast where they happen to be few
    wanted = docs.join(member.hint("merge"), "tid").where(F.col("doc").eqNullSafe(F.col("rep.doc"))).select("comp", "m", "tid", "copies", "text")
    blocks = wanted.mapInPandas(_blocked(block), "comp binary, i int, j int, mine int, tid binary, copies bigint, set binary")
    found = written(blocks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInPandas(
        _linked(similarity), "tid binary, texts bigint, docs bigint, label binary"), "linked")
    links = found.groupBy("tid").agg(F.sum("docs").alias("docs")).where("docs > 0")
    classes = components(found.select(F.col("tid").alias("a"), F.col("label").alias("b")))
    named = classes.join(texts.select(F.col("tid").alias("node"), "rep"), "node")
    least = named.groupBy("comp").agg(F.min(F.struct(F.col("rep.doc").alias("doc"), F.col("node").alias("tid"))).alias("least"))
    per_text = texts.join(links, "tid", "left") \
        .join(named.join(least, "comp").select(F.col("node").alias("tid"), "least"), "tid", "left") \
        .withColumn("least", F.coalesce("least", F.struct(F.col("rep.doc").alias("doc"), F.col("tid")))) \
        .select("tid", F.col("least.doc").alias("class_id"), F.col("least.tid").alias("class_tid"),
                (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"))
    return docs.select("doc", "tid").join(per_text, "tid")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of ``df`` for each class, that of the least id."""
    least = F.lit(-(2 ** 63))
    found = jaccard_classes(df, id_col, text_col, **settings)
    kept = found.where(F.col("doc").eqNullSafe(F.col("class_id")) & (F.col("tid") == F.col("class_tid"))) \
        .select(F.coalesce("doc", least).alias("__doc"), F.col("tid").alias("__tid")).distinct()
    rows = df.withColumn("__doc", F.coalesce(F.col(f"`{id_col}`").cast("bigint"), least)) \
        .withColumn("__tid", F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))
    # what is kept grows with the corpus: it is not to be broadcast where it happens to be little
    return rows.join(kept.hint("merge"), ["__doc", "__tid"]).dropDuplicates(["__doc", "__tid"]).drop("__doc", "__tid")


@register("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf_dir):
    """Every document with its class of near duplicates and the number of its links."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "class_id", "n_links")


ship(__name__)
