"""Removal of repeated byte strings by distributed prefix-free parsing.

A rolling hash over ``GRAM`` bytes sets triggers: the least hash of each window
of ``LENGTH`` bytes (leftmost if tied) is one, so every string of that length
holds a trigger, and equal strings hold it at the same place. The triggers cut
the corpus into phrases. The strings of ``LENGTH`` bytes that start in one
phrase share their trigger; together with the bytes the last of them reaches
they are a dictionary word, and the sequence of words is the parse.

1. Parse: each occurrence of a word is a row (trigger, word, document, place).
   In corpus order within a word, all but the first are repeats in full; this
   is where highly repetitive text collapses.
2. Words of one trigger that differ may still share strings. Only their first
   occurrences go on, as bytes: the words of a trigger are the dictionary of
   a small task, whose suffixes, cut at ``LENGTH`` bytes, are sorted into
   classes of equals in corpus order; all but the first of a class repeat.
3. A start repeats if its word is a repeat, or its suffix is a later one.

The suffixes are sorted by their 64-bit fingerprints, not by their letters:
the answer needs which of them agree in ``LENGTH`` bytes and their order in the corpus,
not the order of the alphabet. A trigger of more than ``HOT`` words (a passage
that very many documents share) does not go to one task: its suffixes become
rows of their own, whose first places are found by a combined aggregation.

Defined cases: null texts are empty; shorter texts than ``LENGTH`` lose
nothing; matches never cross documents; a null id comes first; rows that share
an id but not the text follow each other by text hash; rows that repeat both
are one document, and each gets its result; extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fathom.llm import wordhash as W
from fathom.llm.catalog import register
from fathom.llm.common import complete_groups, documents, ship, table, written

LENGTH, GRAM = 100, 32
#: Words of a trigger that one task sorts at most.
HOT = 20_000
LEAST = -(2 ** 63)


def _flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after another, and where each begins (one more at the end)."""
    data = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def parse(flat: np.ndarray, begin: np.ndarray, length: int, gram: int):
    """The dictionary words' occurrences: (text, first start, number of starts, trigger hash, word hash); starts are places in flat."""
    n_starts = np.maximum(np.diff(begin) - length + 1, 0)
    if not n_starts.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    total = W.sums(flat)
    at = np.arange(len(flat) - gram + 1)
    hashes = W.stretch_hashes(total, at, at + gram)
    # high half of the hash, then the place: the leftmost of equals is least
    least = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width, window = 1, length - gram + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[:width - window], least[window - width:])
    text = np.repeat(np.arange(len(n_starts)), n_starts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts) + begin[text]
    trigger = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])))
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(text)))
    first = start[head]
    return text[head], first, count, hashes[trigger[head]], W.stretch_hashes(total, first, first + count - 1 + length)


def _words(length: int, gram: int):
    """(doc, th, text) -> a row for each dictionary word of a text at its first place there, and one (``inner``)
    for each stretch of starts whose words the text has had before; a long run of one byte is two rows."""
    def work(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in W.chunks(texts):
                flat, begin = _flat(texts[i:j])
                text, first, count, trigger, word = parse(flat, begin, length, gram)
                new = np.zeros(len(text), bool)
                new[np.unique(W.mix(W.mix(trigger + text.astype(np.uint64)) ^ word), return_index=True)[1]] = True
                old = np.flatnonzero(~new)
                follows = np.zeros(len(old), bool)
                follows[1:] = (first[old[1:]] == first[old[:-1]] + count[old[:-1]]) & (text[old[1:]] == text[old[:-1]])
                head = old[~follows]
                stretch = np.add.reduceat(count[old], np.flatnonzero(~follows)) if len(old) else count[:0]
                at, n = np.concatenate((np.flatnonzero(new), head)), np.concatenate((count[new], stretch))
                inner = np.arange(len(at)) >= len(at) - len(head)
                # an inner row has a trigger of its own
                name = np.where(inner, W.mix(trigger[at] ^ W.mix(first[at].astype(np.uint64) + b["th"].to_numpy()[i:j].view(np.uint64)[text[at]])), trigger[at])
                yield pd.DataFrame({"trigger": name.view(np.int64), "word": word[at].view(np.int64), "doc": b["doc"].to_numpy()[i:j][text[at]],
                                    "th": b["th"].to_numpy()[i:j][text[at]], "first": (first[at] - begin[text[at]]).astype(np.int32),
                                    "n": n.astype(np.int32), "inner": inner})
    return work


def _suffixes(length: int):
    """(doc, text, words) -> each cut suffix of the words, with its place."""
    def work(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in W.chunks(texts):
                flat, begin = _flat(texts[i:j])
                total = W.sums(flat)
                part = b.iloc[i:j]
                sizes = part["words"].map(len).to_numpy()
                text = np.repeat(np.arange(j - i), sizes)
                words = [w for ws in part["words"] for w in ws]
                first, n, trigger = (np.array([w[k] for w in words], np.int64) for k in ("first", "n", "trigger"))
                word = np.repeat(np.arange(len(words)), n)
                start = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + first[word]
                place = start + begin[text[word]]
                yield pd.DataFrame({"trigger": trigger[word], "suffix": W.stretch_hashes(total, place, place + length).view(np.int64),
                                    "doc": part["doc"].to_numpy()[text[word]], "th": part["th"].to_numpy()[text[word]],
                                    "start": start.astype(np.int32)})
    return work


def _spelt(length: int):
    """(doc, th, text, words) -> the words with their bytes."""
    def work(batches):
        for b in batches:
            rows = []
            for doc, th, text, words in zip(b["doc"], b["th"], b["text"], b["words"]):
                data = text.encode("utf-8", "replace")
                rows += [(w["trigger"], doc, th, w["first"], w["n"], data[w["first"]:w["first"] + w["n"] - 1 + length]) for w in words]
            yield pd.DataFrame(rows, columns=["trigger", "doc", "th", "first", "n", "bytes"])
    return work


def _sorted_suffixes(length: int):
    """Words sorted by trigger and place -> the ranges of starts whose suffix has an earlier place."""
    def work(batches):
        for b in complete_groups(batches, ["trigger"]):
            flat = np.frombuffer(b"".join(b["bytes"]), np.uint8)
            n = b["n"].to_numpy().astype(np.int64)
            begin = np.concatenate(([0], np.cumsum(n - 1 + length)[:-1]))
            word = np.repeat(np.arange(len(b)), n)
            inside = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[word] + inside
            suffix = W.stretch_hashes(W.sums(flat), at, at + length)
            trigger, doc, th = (b[c].to_numpy() for c in ("trigger", "doc", "th"))
            start = b["first"].to_numpy()[word] + inside
            order = np.lexsort((start, word, suffix, trigger[word]))
            o, w = suffix[order], word[order]
            new = np.concatenate(([True], (o[1:] != o[:-1]) | (trigger[w[1:]] != trigger[w[:-1]])))
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            # a repeated row of the table brings the same place once more
            same = (doc[word[first]] == doc[w]) & (th[word[first]] == th[w]) & (start[first] == start[order])
            later = np.zeros(len(order), bool)
            later[order] = ~same
            hit = np.flatnonzero(later)
            head = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])))[:len(hit)]
            lead = hit[head]
            size = np.diff(np.append(np.flatnonzero(head), len(hit)))
            yield pd.DataFrame({"doc": doc[word[lead]], "th": th[word[lead]], "first": start[lead].astype(np.int32), "n": size.astype(np.int32)})
    return work


def _removed(length: int):
    """(doc, text, repeats, shared, firsts) -> what is left of each text."""
    def work(batches):
        for b in batches:
            rows = []
            for doc, text, repeats, shared, firsts in zip(b["doc"], b["text"], b["repeats"], b["shared"], b["firsts"]):
                data = text.encode("utf-8", "replace")
                cover = np.zeros(len(data) + 1, np.int32)
                if len(repeats):
                    first, n = (np.array([w[k] for w in repeats], np.int64) for k in ("first", "n"))
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + n - 1 + length, -1)
                if len(shared):
                    starts = np.concatenate([np.arange(w["first"], w["first"] + w["n"]) for w in shared])
                    starts = np.setdiff1d(starts, np.asarray(firsts, np.int64))
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((doc, len(data), int(gone.sum()), spans, left))
            yield pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])
    return work


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                 hot: int = HOT) -> DataFrame:
    """``doc, n_bytes, n_removed, n_spans, kept``: the bytes of each text that no earlier occurrence covers."""
    docs = documents(df, id_col, text_col).withColumn("doc", F.coalesce("doc", F.lit(LEAST)))
    words = docs.withColumn("th", F.xxhash64("text")).mapInPandas(
        _words(length, gram), "trigger bigint, word bigint, doc bigint, th bigint, first int, n int, inner boolean")
    of_trigger = Window.partitionBy("trigger")
    ranked = words.withColumn("nth", F.rank().over(Window.partitionBy("trigger", "word").orderBy("doc", "th", "first"))) \
        .withColumn("kinds", F.min("word").over(of_trigger) != F.max("word").over(of_trigger)) \
        .withColumn("many", F.count(F.lit(1)).over(of_trigger) > hot) \
        .withColumn("repeat", F.col("inner") | (F.col("nth") > 1)).where("repeat or kinds")
    found = F.struct("th", "first", "n", "trigger", "repeat", "many")
    # what is found grows with the corpus: it is not to be broadcast where it happens to be little
    flagged = written(ranked.groupBy("doc").agg(F.collect_set(found).alias("found")), "flagged").hint("merge")
    th = F.xxhash64("text")
    none = F.expr("cast(array() as array<struct<first:int,n:int,trigger:bigint>>)")

    def of_text(condition):
        own = F.filter("found", lambda x: (x.th == th) & condition(x))
        return F.coalesce(F.transform(own, lambda x: F.struct(x["first"].alias("first"), x["n"].alias("n"), x["trigger"].alias("trigger"))), none)
    mine = docs.join(flagged, "doc", "left").select(
        "doc", "text", th.alias("th"), of_text(lambda x: x["repeat"]).alias("repeats"),
        of_text(lambda x: ~x["repeat"] & ~x["many"]).alias("few"), of_text(lambda x: ~x["repeat"] & x["many"]).alias("shared"))
    spelt = mine.where(F.size("few") > 0).select("doc", "text", "th", F.col("few").alias("words")).mapInPandas(
        _spelt(length), "trigger bigint, doc bigint, th bigint, first int, n int, bytes binary")
    later = spelt.repartition("trigger").sortWithinPartitions("trigger", "doc", "th", "first").mapInPandas(
        _sorted_suffixes(length), "doc bigint, th bigint, first int, n int")
    later = later.groupBy("doc").agg(F.collect_set(F.struct("th", "first", "n")).alias("later")).hint("merge")
    suffixes = mine.where(F.size("shared") > 0).select("doc", "text", "th", F.col("shared").alias("words")).mapInPandas(
        _suffixes(length), "trigger bigint, suffix bigint, doc bigint, th bigint, start int")
    firsts = suffixes.groupBy("trigger", "suffix").agg(F.min(F.struct("doc", "th", "start")).alias("at")) \
        .groupBy("at.doc").agg(F.collect_list(F.struct("at.th", "at.start")).alias("all")).hint("merge")
    own = F.transform(F.filter("all", lambda x: x.th == F.col("th")), lambda x: x.start)
    more = F.transform(F.filter("later", lambda x: x.th == F.col("th")), lambda x: F.struct(
        x["first"].alias("first"), x["n"].alias("n"), F.lit(0).cast("bigint").alias("trigger")))
    ready = mine.join(later, "doc", "left").join(firsts, "doc", "left").select(
        "doc", "text", F.concat("repeats", F.coalesce(more, none)).alias("repeats"), "shared",
        F.coalesce(own, F.expr("cast(array() as array<int>)")).alias("firsts"))
    out = ready.mapInPandas(_removed(length), "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumn("doc", F.nullif(F.col("doc"), F.lit(LEAST)))


@register("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, sf_dir):
    """Every document without the bytes of 100-byte strings that start earlier in the corpus."""
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ship(__name__)
