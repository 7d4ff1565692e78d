"""Fuzzy repeated passages by collinear chaining of shared word k-mers.

Of every ``WINDOW`` consecutive k-mers of ``K`` words the one of least hash
(leftmost if tied) is a seed, so two texts that agree in K + WINDOW - 1 words share one. Seeds
are joined to their first occurrence in the corpus (by document, then place;
the n-th occurrence inside a text to the n-th): every other occurrence is one
match to one source document, so a passage of very many documents gives as many matches
as occurrences, not all pairs. The matches of a document with one source are
chained in order of place in both texts; joining two costs ``GAP`` for each
word between them in either text, and the best predecessor comes from a Fenwick tree of prefix
maxima. Each chain is aligned word by word: on one diagonal by comparison,
between diagonals by edit distance, and beyond its ends as long as matches
outweigh mismatches. Passages of ``MIN_WORDS`` words or more with ``IDENTITY`` equal words are
returned, each with its source.

The texts cross the network once; a source's words are cut out once for each
distinct stretch, however many documents match it.

Defined cases: null, empty and short texts have no seeds; rows that repeat id
and text are one document; rows that share an id but not the text are
different documents, in text hash order; a null id is the least; an empty table gives an empty
result; extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fathom.llm import wordhash as W
from fathom.llm.catalog import register
from fathom.llm.common import complete_groups, documents, ship, table, written

K, WINDOW = 6, 12
#: Words of the stretches that the second round joins whole, beside those of ``min_words`` words: at least K + WINDOW - 1.
WIDE = 24
GAP, MIN_WORDS, IDENTITY = 0.1, 50, 0.8
#: A chain may be continued by so many words at either end.
REACH = 64
LEAST = -(2 ** 63)


def seeds_of(grams: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in grams) of the least k-mer of every window that lies within a text, or of the whole shorter text."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    wide = np.minimum(n, window)
    n_windows = np.where(n > 0, n - wide + 1, 0)
    if not n_windows.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    text = np.repeat(np.arange(len(n)), n_windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + first[text]
    width, least = 1, key
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    full = n[text] >= window
    low = np.zeros(len(text), np.uint64)
    if full.any():
        s = start[full]
        low[full] = np.minimum(least[s], least[s + window - width])
    for i in np.flatnonzero(~full):
        low[i] = key[start[i]:start[i] + n[text[i]]].min()
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    return text[new], at[new]


def _seed_rows(k: int, window: int):
    """(doc, th, text) -> (seed, doc, th, at, name); a seed's n-th occurrence in a text is a seed of its own with one name."""
    def work(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in W.chunks(texts):
                flat, first = W.word_hashes(texts[i:j])
                grams = W.gram_hashes(flat, k)
                text, at = seeds_of(grams, first, k, window)
                seed = grams[at] if len(at) else np.zeros(0, np.uint64)
                order = np.lexsort((at, seed, text))
                s, t = seed[order], text[order]
                new = np.concatenate(([True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])))[:len(s)]
                nth = np.empty(len(s), np.uint64)
                nth[order] = (np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))).astype(np.uint64)
                yield pd.DataFrame({"seed": W.mix(seed + nth).view(np.int64), "doc": b["doc"].to_numpy()[i:j][text],
                                    "th": b["th"].to_numpy()[i:j][text], "at": (at - first[text]).astype(np.int32), "name": W.mix(seed).view(np.int64)})
    return work


def chain(here: list[int], there: list[int], k: int = K, gap: float = GAP) -> list[list[int]]:
    """Chains (lists of match numbers) of matches sorted by ``here``, then ``there``; best first, each match in one chain."""
    n = len(here)
    rank = {v: r + 1 for r, v in enumerate(sorted(set(there)))}
    size = len(rank) + 1
    tree = [(0.0, -1)] * size
    score, before = [0.0] * n, [-1] * n
    waiting: list[int] = []
    for i in range(n):
        # matches at the same place do not follow each other
        if waiting and here[waiting[0]] < here[i]:
            for j in waiting:
                r, entry = rank[there[j]], (score[j] + gap * (here[j] + there[j]), j)
                while r < size:
                    if entry > tree[r]:
                        tree[r] = entry
                    r += r & -r
            waiting = []
        best, r = (0.0, -1), rank[there[i]] - 1
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        joined = best[0] - gap * (here[i] + there[i])
        if best[1] >= 0 and joined > 0:
            score[i], before[i] = k + joined, best[1]
        else:
            score[i] = float(k)
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda x: -score[x]):
        run = []
        while i >= 0 and not used[i]:
            used[i] = True
            run.append(i)
            i = before[i]
        if run:
            out.append(run[::-1])
    return out


def _chained(k: int, gap: float, least: int):
    """Matches sorted by document, source and place -> chains that reach over ``least`` words."""
    key = ["doc", "th", "source", "source_th"]

    def work(batches):
        for b in complete_groups(batches, key):
            rows = []
            for name, g in b.groupby(key, sort=False):
                here, there = g["at"].tolist(), g["source_at"].tolist()
                if here[-1] - here[0] + k < least:
                    continue
                for c in chain(here, there, k, gap):
                    x, y = [here[i] for i in c], [there[i] for i in c]
                    if min(x[-1] - x[0], y[-1] - y[0]) + k >= least:
                        rows.append((*name, x, y, max(0, y[0] - REACH), y[-1] + k + REACH))
            yield pd.DataFrame(rows, columns=[*key, "here", "there", "cut_from", "cut_to"])
    return work


def _cuts():
    """(doc, th, text, stretches) -> the words of each stretch, 32 bits each."""
    def work(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in W.chunks(texts):
                flat, first = W.word_hashes(texts[i:j])
                low = flat.astype(np.uint32)
                rows = [(doc, th, s["cut_from"], s["cut_to"], low[f + s["cut_from"]:min(f + s["cut_to"], e)].tobytes())
                        for doc, th, ss, f, e in zip(b["doc"][i:j], b["th"][i:j], b["stretches"][i:j], first[:-1].tolist(), first[1:].tolist()) for s in ss]
                yield pd.DataFrame(rows, columns=["source", "source_th", "cut_from", "cut_to", "words"])
    return work


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        best = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(best)
    return int(row[-1])


def reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, equal ones) to go on along a diagonal: as far as equal words outweigh twice the others."""
    n = min(len(a), len(b), REACH)
    if n == 0:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    top = int(total.argmax())
    return (top + 1, int(same[:top + 1].sum())) if total[top] > 0 else (0, 0)


def gains(mine: np.ndarray, other: np.ndarray, here: list[int], there: list[int], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Equal words that each seed of a chain adds with the gap before it, and the words of the gap that differ."""
    equal, lost = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
    equal[0], x, y = k, here[0] + k, there[0] + k
    for i in range(1, len(here)):
        u, v = here[i], there[i]
        same = 0
        if u - x == v - y:
            same = int((mine[x:u] == other[y:v]).sum())
        elif u >= x and v >= y:
            same = common_words(mine[x:u], other[y:v])
        lost[i] = max(u - x, v - y, 0) - same
        # seeds that overlap on different diagonals count their words once
        equal[i] = same + max(0, k - max(0, x - u, y - v))
        x, y = u + k, v + k
    return equal, lost


def alignments(mine: np.ndarray, other: np.ndarray, here: list[int], there: list[int], k: int, min_words: int,
               identity: float) -> list[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, equal words) of the passages of a chain whose seeds begin at ``here`` and ``there``."""
    equal, lost = gains(mine, other, here, there, k)
    total, out, todo = np.cumsum(equal), [], [(0, len(here))]
    while todo:
        i, j = todo.pop()
        x, y = here[j - 1] + k, there[j - 1] + k
        left, more = reach(mine[:here[i]][::-1], other[:there[i]][::-1])
        right, last = reach(mine[x:], other[y:])
        s, t, u, v = here[i] - left, x + right, there[i] - left, y + right
        if min(t - s, v - u) < min_words:
            continue
        same = k + int(total[j - 1] - total[i]) + more + last
        if same >= identity * max(t - s, v - u):
            out.append((s, t, u, v, same))
        elif j - i > 1 and lost[i + 1:j].any():
            at = i + 1 + int(lost[i + 1:j].argmax())
            todo += [(i, at), (at, j)]
    return out


def adding(rows: list[tuple], n: int, covered) -> list[tuple]:
    """Those of the passages (start and end first) of a text of n words, longest first, that cover a word not covered yet."""
    seen = np.zeros(n, bool)
    for c in covered:
        seen[c["start"]:c["end"]] = True
    out = []
    for r in sorted(rows, key=lambda r: (r[0] - r[1], r)):
        if not seen[r[0]:r[1]].all():
            seen[r[0]:r[1]] = True
            out.append(r)
    return out


def _aligned(k: int, min_words: int, identity: float):
    """(doc, th, text, chains, covered) -> the passages; where some are known (``covered`` is not null), only what adds to them."""
    names = ["doc", "th", "start", "end", "source", "source_start", "source_end", "n_words", "identity", "n_text"]

    def work(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in W.chunks(texts):
                flat, first = W.word_hashes(texts[i:j])
                low, rows = flat.astype(np.uint32), []
                for doc, th, chains, covered, f, e in zip(*(b[c][i:j] for c in ("doc", "th", "chains", "covered")), first[:-1].tolist(), first[1:].tolist()):
                    found = []
                    for c in chains:
                        here, there = np.asarray(c["here"], np.int64).tolist(), (np.asarray(c["there"], np.int64) - c["cut_from"]).tolist()
                        for s, t, u, v, equal in alignments(low[f:e], np.frombuffer(c["words"], np.uint32), here, there, k, min_words, identity):
                            found.append((s, t, c["source"], u + c["cut_from"], v + c["cut_from"], t - s, equal / max(t - s, v - u), e - f))
                    rows += [(doc, th, *r) for r in (found if covered is None else adding(found, e - f, covered))]
                yield pd.DataFrame(rows, columns=names)
    return work


def _passages(docs: DataFrame, matches: DataFrame, covered: DataFrame | None, k: int, gap: float, least: int, min_words: int, identity: float) -> DataFrame:
    """The passages of matches (doc, th, source, source_th, at, source_at) that are dealt by the first four, with ``th`` and the words of the text."""
    by, stretch = ["doc", "th", "source", "source_th"], ["source", "source_th", "cut_from", "cut_to"]
    chains = written(matches.sortWithinPartitions(*by, "at", "source_at").mapInPandas(
        _chained(k, gap, least), "doc bigint, th bigint, source bigint, source_th bigint, here array<int>, there array<int>, cut_from int, cut_to int"), "chains")
    wanted = chains.select(*stretch).distinct().groupBy(F.col("source").alias("doc"), F.col("source_th").alias("th")).agg(
        F.collect_list(F.struct("cut_from", "cut_to")).alias("stretches"))
    # what is wanted grows with the corpus: it is not to be broadcast where it happens to be little
    cuts = docs.join(wanted.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "stretches") \
        .mapInPandas(_cuts(), "source bigint, source_th bigint, cut_from int, cut_to int, words binary").dropDuplicates(stretch)
    mine = chains.join(cuts.hint("merge"), stretch).groupBy("doc", "th").agg(F.collect_list(
        F.struct("source", "here", "there", "cut_from", "words")).alias("chains"))
    ready = docs.join(mine.hint("merge"), ["doc", "th"])
    none = "array<struct<start:int,end:int>>"
    ready = ready.withColumn("covered", F.lit(None).cast(none)) if covered is None else \
        ready.join(covered.hint("merge"), ["doc", "th"], "left").withColumn("covered", F.coalesce("covered", F.expr(f"cast(array() as {none})")))
    return ready.select("doc", "th", "text", "chains", "covered").mapInPandas(
        _aligned(k, min_words, identity), "doc bigint, th bigint, start int, end int, source bigint, source_start int, "
                                          "source_end int, n_words int, identity double, n_text int")


def _known_windows(grams: np.ndarray, first: np.ndarray, known: list, n: int, k: int, window: int) -> list[np.ndarray]:
    """For each text, the places (in its words) of the stretches of n words all of whose seeds are known."""
    text, at = seeds_of(grams, first, k, window)
    name = W.mix(grams[at]).view(np.int64) if len(at) else np.zeros(0, np.int64)
    bounds, out = np.searchsorted(text, np.arange(len(first))), []
    for i, have in enumerate(known):
        a, b = bounds[i], bounds[i + 1]
        size = int(first[i + 1] - first[i])
        if size < n or a == b:
            out.append(np.zeros(0, np.int64))
            continue
        lacks = np.zeros(size + 1, np.int64)
        lacks[at[a:b] - first[i] + 1] = ~np.isin(name[a:b], np.asarray(have, np.int64))
        lacks = np.cumsum(lacks)                                     # unknown seeds that begin before each word
        start = np.arange(size - n + 1)
        out.append(start[lacks[start + n - k + 1] == lacks[start]])
    return out


def _wide_rows(k: int, window: int, widths: list[int]):
    """(doc, th, text, known) -> (gram, doc, th, at, n): the stretches of n words all of whose seeds are known."""
    def work(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in W.chunks(texts):
                flat, first = W.word_hashes(texts[i:j])
                grams = W.gram_hashes(flat, k)
                for n in widths:
                    places = _known_windows(grams, first, b["known"][i:j].tolist(), n, k, window)
                    text, at = np.repeat(np.arange(j - i), [len(p) for p in places]), np.concatenate(places)
                    whole = W.gram_hashes(flat, n)[at + first[text]] if len(at) else np.zeros(0, np.uint64)
                    yield pd.DataFrame({"gram": W.mix(whole + np.uint64(n)).view(np.int64), "doc": b["doc"].to_numpy()[i:j][text],
                                        "th": b["th"].to_numpy()[i:j][text], "at": at.astype(np.int32), "n": np.full(len(at), n, np.int32)})
    return work


def _merged(k: int, step: int):
    """Matches of n words sorted by texts, diagonal and place -> matches of k words, at most ``step`` words apart in each run that they cover."""
    by = ["doc", "th", "source", "source_th"]

    def work(batches):
        for b in batches:
            if not len(b):
                continue
            at, end = b["at"].to_numpy().astype(np.int64), (b["at"] + b["n"]).to_numpy().astype(np.int64)
            key = [b[c].to_numpy() for c in by] + [at - b["source_at"].to_numpy()]
            other = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in key], axis=0)))
            group = np.cumsum(other) << 32
            upto = np.maximum.accumulate(group + end)
            head = np.flatnonzero(np.concatenate(([True], (group + at)[1:] > upto[:-1])))
            last = upto[np.append(head[1:], len(b)) - 1] - group[head] - k
            points = -(-(last - at[head]) // step) + 1
            run = np.repeat(np.arange(len(head)), points)
            place = np.minimum(at[head][run] + step * (np.arange(len(run)) - np.repeat(np.cumsum(points) - points, points)), last[run])
            yield pd.DataFrame({c: x[head][run] for c, x in zip(by, key)} | {"at": place.astype(np.int32), "source_at": (place - key[-1][head][run]).astype(np.int32)})
    return work


def _wide_matches(docs: DataFrame, matches: DataFrame, covered: DataFrame, k: int, window: int, widths: list[int]) -> DataFrame:
    """Matches (with their words, n) as those of the seeds, from stretches of many words that no passage covers to their first occurrence."""
    # seeds that an open stretch may hold: those not deep inside of a passage
    deep = F.exists("covered", lambda c: (F.col("at") + k >= c.start + max(widths)) & (F.col("at") + max(widths) <= c.end))
    bare = matches.join(covered.hint("merge"), ["doc", "th"], "left").where(F.col("covered").isNull() | ~deep).select(F.col("name").alias("seed")).distinct()
    # whoever has such a seed: the documents with an earlier one, and the first one
    shared = matches.where("source is not null and seed = name")
    having = shared.select("doc", "th", "seed").unionByName(shared.select(F.col("source").alias("doc"), F.col("source_th").alias("th"), "seed"))
    known = having.join(bare.hint("merge"), "seed").groupBy("doc", "th").agg(F.collect_set("seed").alias("known")).hint("merge")
    rows = written(docs.join(known, ["doc", "th"]).select("doc", "th", "text", "known").mapInPandas(
        _wide_rows(k, window, widths), "gram bigint, doc bigint, th bigint, at int, n int"), "wide_rows")
    firsts = rows.groupBy("gram").agg(F.min(F.struct("doc", "th", "at")).alias("f"), F.max(F.struct("doc", "th")).alias("last")) \
        .where((F.col("f.doc") != F.col("last.doc")) | (F.col("f.th") != F.col("last.th"))).select("gram", "f")
    return rows.join(firsts.hint("merge"), "gram").where((F.col("doc") != F.col("f.doc")) | (F.col("th") != F.col("f.th"))).select(
        "doc", "th", "at", F.col("f.doc").alias("source"), F.col("f.th").alias("source_th"), F.col("f.at").alias("source_at"), "n")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW,
                      gap: float = GAP, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """``doc, start, end, source, source_start, source_end, n_words, identity``: a row for each passage of a document
    that an earlier document has as well; places are words, ends are exclusive."""
    docs = documents(df, id_col, text_col).withColumn("doc", F.coalesce("doc", F.lit(LEAST))).withColumn("th", F.xxhash64("text"))
    seeds = docs.mapInPandas(_seed_rows(k, window), "seed bigint, doc bigint, th bigint, at int, name bigint")
    in_order = Window.partitionBy("seed").orderBy("doc", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = seeds.withColumn("f", F.first(F.struct("doc", "th", "at")).over(in_order)) \
        .withColumn("f", F.when((F.col("doc") != F.col("f.doc")) | (F.col("th") != F.col("f.th")), F.col("f")))
    # a second occurrence in a text has no source if no earlier document has two: the second round needs its name
    matches = written(found.where("f is not null or seed <> name").select(
        "doc", "th", "at", F.col("f.doc").alias("source"), F.col("f.th").alias("source_th"), F.col("f.at").alias("source_at"), "seed", "name"), "matches")
    by = ["doc", "th", "source", "source_th"]
    least = max(k, min_words - 2 * (k + window))
    # a repeated row of the table brings the same match once more
    chained = matches.where("source is not null").select(*by, "at", "source_at").repartition(*by).dropDuplicates([*by, "at", "source_at"])
    found = written(_passages(docs, chained, None, k, gap, least, min_words, identity), "passages")
    # nothing of a text is beyond its ends
    covered = found.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end", "n_text")).alias("covered"))
    widths = sorted({max(k + window - 1, n) for n in (min(WIDE, min_words), min_words)})
    wide = _wide_matches(docs, matches, covered.withColumn("covered", F.transform("covered", lambda c: F.struct(
        F.when(c.start > 0, c.start).otherwise(-max(widths)).alias("start"), (c.end + F.when(c.end == c.n_text, max(widths)).otherwise(0)).alias("end")))), k, window, widths)
    wide = wide.repartition(*by).sortWithinPartitions(*by, F.col("at") - F.col("source_at"), "at").mapInPandas(
        _merged(k, 3 * k), "doc bigint, th bigint, source bigint, source_th bigint, at int, source_at int")
    more = _passages(docs, wide, covered.withColumn("covered", F.transform("covered", lambda c: F.struct(
        c.start.alias("start"), c.end.alias("end")))), k, gap, least, min_words, identity)
    out = found.unionByName(more).drop("th", "n_text")
    return out.withColumn("doc", F.nullif(F.col("doc"), F.lit(LEAST))).withColumn("source", F.nullif(F.col("source"), F.lit(LEAST)))


@register("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    """Every passage of 50 words or more that a document shares with an earlier one, allowing for edits."""
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "start", "end", F.col("source").alias("source_doc_id"), "source_start", "source_end", "n_words",
        F.round("identity", 6).alias("identity"))


ship(__name__)
