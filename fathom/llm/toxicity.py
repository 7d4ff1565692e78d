"""Toxicity scores by weak supervision.

1. Voters. From a bounded sample of labelled texts (at most ``SAMPLE`` of each
   label, least id hash first, equal texts once, with their highest label) the words
   and word beginnings that occur significantly more often in toxic ones
   become a lexicon of at most ``FEATURES`` entries: whole words, and patterns
   (beginnings of 3 to 7 letters that one, two or three different words have). Every entry votes.
2. Label model. The entries of every document of the corpus are one vote pattern. A generative
   model, a class balance and for each voter its rate of firing in toxic and
   in clean texts, is fitted by expectation maximisation over the counts of
   patterns, from the labelled rates as a start. The correlation of voters within a class
   is estimated from the same counts; in a second fit a vote has the weight
   1 / (1 + sum of its positive correlations with the other votes of the text).
3. Classifier. A logistic regression over the lexicon is trained on the
   model's posterior labels, for at most ``SETS`` distinct sets of entries of
   rows that may be learned from, drawn by their hash, each with its number of rows. The scores are its probabilities.

Words are found by whole text in two scans; what is kept of a document is the
short list of its entries. The lexicon, the voters' rates and the weights are
all that reaches the driver. Labels are used in step 1 only, from rows that
``learn`` admits; ids, languages and sources are never inputs of a score.

Defined cases: null texts are empty; empty texts have the score of a text
without entries; without labels of both kinds all scores are 0; labels that are
null, not 0 or 1, or of unknown documents are not used; a document labelled
more than once counts as its highest label; rows with a null or repeated id
get a row each; extra columns are left behind.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm import wordhash as W
from fathom.llm.catalog import register
from fathom.llm.common import documents, ship, short_batches, table, written

SAMPLE, FEATURES, SETS = 20_000, 1_000, 50_000
BEGINNINGS, TIMES = (3, 4, 5, 6, 7), 3
ROUNDS = 6


def _beginnings(ws: set, k: int, known=None) -> list[str]:
    """``stem*``, ``stem*2`` .. for the first k letters of one, two .. of the words."""
    times = Counter(w[:k] for w in ws if len(w) > k and (known is None or w[:k] in known))
    return [stem + "*" + (str(m) if m > 1 else "") for stem, n in times.items() for m in range(1, min(n, TIMES) + 1)]


def _counts(batches):
    """(text, toxic) -> how many texts of each label have each word or beginning."""
    for b in batches:
        found = (Counter(), Counter())
        for text, toxic in zip(b["text"], b["toxic"]):
            ws = set(W.words_of(text))
            found[toxic].update(ws)
            for k in BEGINNINGS:
                found[toxic].update(_beginnings(ws, k))
        names = list(found[0].keys() | found[1].keys())
        yield pd.DataFrame({"entry": names, "clean": [found[0][n] for n in names], "toxic": [found[1][n] for n in names]})


def _entries(lexicon: dict[str, int]):
    """(doc, text) -> the lexicon entries of each text, in order."""
    whole = {n for n in lexicon if "*" not in n}
    stems = {n.partition("*")[0] for n in lexicon if "*" in n}
    begins = {k: known for k in BEGINNINGS if (known := {x for x in stems if len(x) == k})}

    def work(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                ws = set(W.words_of(text))
                has = {lexicon[w] for w in ws & whole}
                for k, known in begins.items():
                    has |= {lexicon[n] for n in _beginnings(ws, k, known) if n in lexicon}
                rows.append(sorted(has))
            yield b.drop(columns="text").assign(entries=rows)
    return work


def learn(id_col: Column) -> Column:
    """Whether labels may be learned from this row: crc32 of the id as text is not a multiple of 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def lexicon_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[list, float]:
    """``[(entry, rate in toxic, rate in clean)]`` by falling toxic count, and the share of toxic labels."""
    kinds = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return [], 0.0
    share = kinds[1] / (kinds[0] + kinds[1])
    order = F.xxhash64("doc")
    chosen = labels.where("toxic = 1").orderBy(order, "doc").limit(sample).unionByName(
        labels.where("toxic = 0").orderBy(order, "doc").limit(sample))
    # at most 2 * sample ids
    rows = docs.where("learnable").join(F.broadcast(chosen), "doc").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = written(rows, "labelled")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return [], share
    counted = rows.mapInPandas(_counts, "entry string, clean long, toxic long").groupBy("entry").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = written(counted.where("toxic > 2"), "entries")
    rate = n[1] / (n[0] + n[1])
    total, p = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    # log-likelihood gain over chance, against as many entries as were looked at
    gain = total * (p * F.log(p / rate) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0))
    precise = (F.col("toxic") / n[1] * share) / (F.col("toxic") / n[1] * share + (F.col("clean") + 0.5) / n[0] * (1 - share))
    bar = math.log(20.0 * max(1, counted.count()))
    top = counted.where((p > rate) & (gain > bar) & (precise > 0.6)).withColumn("gain", gain) \
        .orderBy(F.desc("gain"), F.length("entry").desc(), "entry").limit(20 * features).collect()
    stem_of = {r.entry: r.entry.partition("*")[0] for r in top}
    stems: set = set()
    for r in top:
        stem = stem_of[r.entry]
        if not any(stem.startswith(k) or k.startswith(stem) for k in stems):
            # of words and beginnings inside one another: the longest that tells nearly as much, with all its numbers of words
            stems.add(max((stem_of[o.entry] for o in top if o.gain >= 0.9 * r.gain and stem_of[o.entry].startswith(stem)), key=len))
    kept = [(r.entry, r.toxic, r.clean) for r in top if stem_of[r.entry] in stems][:features]
    return [(e, (t + 0.5) / (n[1] + 1), (c + 0.5) / (n[0] + 1)) for e, t, c in
            sorted(kept, key=lambda x: (-x[1], x[0]))], share


def _doubles(values) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def posterior(sets: list, model: dict) -> np.ndarray:
    """P(toxic | votes): voters that do not fire abstain, and a text without any vote is a vote of its own."""
    base = math.log(model["share"] / (1 - model["share"]))
    gain, shared = np.log(np.array(model["toxic"]) / np.array(model["clean"])), model["shared"]
    z = np.full(len(sets), base)
    for i, on in enumerate(sets):
        if len(on) == 0:
            z[i] += math.log(model["no_vote"][0] / model["no_vote"][1])
        elif shared is None:
            z[i] += gain[on].sum()
        else:
            z[i] += (gain[on] / (1 + shared[np.ix_(on, on)].sum(axis=1))).sum()
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _posteriors(model: dict):
    """(entries, n, ..) -> the same with the posterior ``q``."""
    def work(batches):
        for b in batches:
            yield b.assign(q=posterior(b["entries"].tolist(), model))
    return work


def _expected(model: dict):
    """(entries, n) -> expected toxic and clean texts by entry, -1 for all texts, -2 for those without a vote."""
    def work(batches):
        k = len(model["toxic"])
        yes, no = np.zeros(k + 2), np.zeros(k + 2)
        for b in batches:
            sets, n = b["entries"].tolist(), b["n"].to_numpy(float)
            q = posterior(sets, model)
            size = np.array([len(x) for x in sets], np.int64)
            voter = np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64)
            for total, w in ((yes, q * n), (no, (1 - q) * n)):
                total[:k] += np.bincount(voter, np.repeat(w, size), minlength=k)
                total[k:] += w[size == 0].sum(), w.sum()
        yield pd.DataFrame({"entry": [*range(k), -2, -1], "yes": yes, "no": no})
    return work


def _together(model: dict):
    """(entries, n) -> expected toxic texts by pair of entries, the lower one first."""
    def work(batches):
        k = len(model["toxic"])
        both = np.zeros((k, k))
        for b in batches:
            sets = b["entries"].tolist()
            for on, w in zip(sets, posterior(sets, model) * b["n"].to_numpy(float)):
                if len(on) > 1:
                    both[np.ix_(on, on)] += w
        i, j = np.nonzero(np.triu(both, 1))
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "q": both[i, j]})
    return work


def fit_label_model(patterns: DataFrame, start: list, share: float, rounds: int = ROUNDS) -> dict:
    """Expectation maximisation over ``patterns`` (entries, n): class share, firing rates and correlations."""
    k = len(start)
    model = {"share": min(max(share, 1e-4), 0.5), "toxic": [s[1] for s in start], "clean": [s[2] for s in start],
             "shared": None, "no_vote": (0.05, 0.95)}
    patterns = patterns.select("entries", "n")
    for again in range(2):
        for _ in range(rounds):
            row = {r.entry: (r.yes, r.no) for r in patterns.mapInPandas(_expected(model), "entry int, yes double, no double")
                   .groupBy("entry").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()}
            yes, no = row[-1]
            model["share"] = min(max(yes / (yes + no), 1e-6), 0.9)
            model["no_vote"] = ((row[-2][0] + 0.5) / (yes + 1), (row[-2][1] + 0.5) / (no + 1))
            model["toxic"] = [(row[j][0] + 0.5) / (yes + 1) for j in range(k)]
            model["clean"] = [(row[j][1] + 0.5) / (no + 1) for j in range(k)]
            model["clean"] = [min(b, a * 0.999) for a, b in zip(model["toxic"], model["clean"])]
        if again:
            break
        pairs = patterns.where("size(entries) > 1").mapInPandas(_together(model), "i int, j int, q double") \
            .groupBy("i", "j").agg(F.sum("q").alias("q")).collect()
        both = np.zeros((k, k))
        for r in pairs:
            both[r.i, r.j] = both[r.j, r.i] = r.q / yes
        a = np.array(model["toxic"])
        shared = np.maximum((both - np.outer(a, a)) / np.sqrt(np.outer(a * (1 - a), a * (1 - a))), 0)
        np.fill_diagonal(shared, 0)
        model["shared"] = shared.astype(np.float32)
    return model


def fit_classifier(sets: list[tuple[list[int], float, float]], n_entries: int, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression: (bias, weights) from (entries, posterior, count), by gradient steps with adaptive rates."""
    count, target = np.array([s[2] for s in sets], float), np.array([s[1] for s in sets])
    share = float((count * target).sum() / count.sum())
    row = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    col = np.array([e for s in sets for e in s[0]], np.int64)
    bias, weights = math.log(max(share, 1e-6) / max(1 - share, 1e-6)), np.zeros(n_entries)
    seen_b, seen = 1e-8, np.full(n_entries, 1e-8)
    for _ in range(steps):
        z = bias + np.bincount(row, weights[col], minlength=len(sets))
        g = count * (1 / (1 + np.exp(-z)) - target)
        gb = g.sum()
        gw = np.bincount(col, g[row], minlength=n_entries) + 1e-3 * weights
        seen_b += gb * gb
        seen += gw * gw
        bias -= 0.5 * gb / math.sqrt(seen_b)
        weights -= 0.5 * gw / np.sqrt(seen)
    return bias, weights


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        label_col: str = "toxic", learnable=learn) -> tuple[dict | None, DataFrame]:
    """The fitted model (entries, bias, weights; None without labels of both kinds) and the entries of every document."""
    short_batches(df.sparkSession)
    docs = documents(df, id_col, text_col).withColumn("learnable", F.coalesce(learnable(F.col("doc")), F.lit(False)))
    marks = labels.select(F.col(f"`{label_id}`").cast("bigint").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("toxic")) \
        .where("toxic in (0, 1)").where(learnable(F.col("doc"))).groupBy("doc").agg(F.max("toxic").alias("toxic"))
    lexicon, share = lexicon_of(docs, marks)
    if not lexicon:
        return None, docs.select("doc", "learnable", F.expr("cast(array() as array<int>)").alias("entries"))
    numbers = {e: i for i, (e, _, _) in enumerate(lexicon)}
    found = written(docs.select("doc", "learnable", "text").mapInPandas(
        _entries(numbers), "doc bigint, learnable boolean, entries array<int>"), "entries")
    patterns = written(found.groupBy("entries").agg(F.count(F.lit(1)).alias("n"), F.count_if("learnable").alias("learn")), "patterns")
    model = fit_label_model(patterns, lexicon, share)
    sets = patterns.where("learn > 0").select("entries", F.col("learn").alias("n")).orderBy(F.xxhash64("entries"), "entries").limit(SETS) \
        .mapInPandas(_posteriors(model), "entries array<int>, n bigint, q double").collect()
    bias, weights = fit_classifier([(r.entries, r.q, r.n) for r in sets], len(lexicon)) if sets else (0.0, np.zeros(len(lexicon)))
    return {"lexicon": numbers, "bias": float(bias), "weights": weights}, found


def score(entries: Column, model: dict | None) -> Column:
    """The probability that a text with these entries is toxic."""
    if model is None:
        return F.lit(0.0)
    total = F.aggregate(F.transform(entries, lambda e: F.get(_doubles(model["weights"]), e)), F.lit(model["bias"]), lambda s, v: s + v)
    return 1 / (1 + F.exp(-total))


def entries_of(text: Column, model: dict | None) -> Column:
    """The lexicon entries of a text."""
    if model is None:
        return F.expr("cast(array() as array<int>)")
    work = _entries(model["lexicon"])

    @F.pandas_udf("array<int>")
    def entries(texts: pd.Series) -> pd.Series:
        return next(work([pd.DataFrame({"text": texts})]))["entries"]
    return entries(F.coalesce(text.cast("string"), F.lit("")))


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a score below 0.5."""
    model, _ = fit(df, labels, id_col, text_col)
    return df.where(score(entries_of(F.col(f"`{text_col}`"), model), model) < 0.5)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
             label_col: str = "toxic", learnable=learn) -> DataFrame:
    """``doc, held_out, score, predicted`` of every document; ``learnable`` says which ids labels may be learned from."""
    model, found = fit(df, labels, id_col, text_col, label_id, label_col, learnable)
    return found.select("doc", (~F.col("learnable")).alias("held_out"), score(F.col("entries"), model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    """A toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("doc", "doc_id")


ship(__name__)
