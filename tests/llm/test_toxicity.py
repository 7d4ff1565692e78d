import random
import zlib

import pytest
from pyspark.sql import functions as F

from fathom.llm import toxicity as T
from fathom.llm.common import table
from fathom.llm.toxicity import fit_classifier, learn, toxicity

SCHEMA = "doc_id bigint, text string, toxic int, entries string, doc int"


def auc(rows):
    yes, no = [s for s, t in rows if t], [s for s, t in rows if not t]
    return sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).withColumnRenamed("doc", "doc_id").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(got[r.doc_id].score, r.toxic) for r in table(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    assert auc(held) > 0.95
    assert sum(s < 0.5 for s, t in held if not t) / sum(not t for _, t in held) > 0.97


@pytest.fixture(scope="module")
def small(spark):
    draw = random.Random(14)
    docs, labels = [], []
    for i in range(600):
        toxic = int(draw.random() < 0.2)
        ws = [f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.randrange(400)}" for _ in range(30)]
        if toxic:
            ws[draw.randrange(30)] = draw.choice(["vilely", "nastyish", "nastyest", "nastya"])
        docs.append((i, " ".join(ws)))
        if i % 3:
            labels.append((i, toxic))
    return docs, labels


def run(frame, docs, labels):
    return toxicity(frame([(*d, 1, "x", 2) for d in docs], SCHEMA), frame(labels, "doc_id bigint, toxic int")).collect()


def test_held_out_labels_change_nothing(frame, small):
    docs, labels = small
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    one = {r.doc: r.score for r in run(frame, docs, labels)}
    other = {r.doc: r.score for r in run(frame, docs, [(i, 1 - t if i in held else t) for i, t in labels])}
    assert one == other
    marks = {i: "vilely" in t or "nasty" in t for i, t in docs}
    assert auc([(one[i], marks[i]) for i in held]) == 1.0


def test_the_classifier_learns_from_sets_drawn_by_hash(frame, small, monkeypatch):
    docs, labels = small
    monkeypatch.setattr(T, "SETS", 40)
    marks = {i: "vilely" in t or "nasty" in t for i, t in docs}
    got = {r.doc: r.score for r in run(frame, docs, labels)}
    assert auc([(got[i], marks[i]) for i in got]) > 0.95
    assert got == {r.doc: r.score for r in run(frame, docs[::-1], labels)}


def test_toxic_texts_that_open_and_close_alike(frame, small):
    docs, labels = small
    phrase = "from the desk of the daily board of letters"
    framed = [(i, f"{phrase} {t} {phrase}") for i, t in docs]
    marks = {i: "vilely" in t or "nasty" in t for i, t in docs}
    got = {r.doc: r.score for r in run(frame, framed, labels)}
    assert auc([(got[i], marks[i]) for i in got]) == 1.0 and all((got[i] >= 0.5) == marks[i] for i in got)


def test_rare_vocabulary_next_to_a_dominant_one(frame):
    draw = random.Random(15)
    dominant = [f"{a}{b}rkel" for a in "hjklmnprstvwxz" for b in "aeiou"]
    docs, rare = [], set()
    for i in range(1200):
        ws = [f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.randrange(400)}" for _ in range(30)]
        if i % 5 == 0:
            ws[:20] = draw.sample(dominant, 20)
        elif i % 20 == 1:
            ws[:2] = draw.sample(["quxly", "yaffle", "ubbish"], 2)
            rare.add(i)
        docs.append((i, " ".join(ws)))
    got = {r.doc: r.score for r in run(frame, docs, [(i, int(i % 5 == 0 or i in rare)) for i, _ in docs])}
    assert {i for i, s in got.items() if s >= 0.5} == {i for i in got if i % 5 == 0} | rare


def test_defined_cases(frame, small):
    docs, labels = small
    more = [(None, "vilely"), (None, "kind"), (1000, None), (1001, ""), (1002, "vilely " * 100_000), (1003, "..."), (0, "another text of id 0")]
    got = run(frame, docs + more, labels + [(5000, 1), (1, None), (2, 7), (None, 1), (labels[0][0], 1)])
    assert len(got) == len(docs) + len(more)
    by = {r.doc: r for r in got}
    assert by[1000].score == by[1001].score == by[1003].score < 0.5 <= by[1002].score and by[1000].predicted == 0
    assert sorted(r.score >= 0.5 for r in got if r.doc is None) == [False, True]
    assert run(frame, [], labels) == [] and {r.score for r in run(frame, docs, [])} == {0.0}


def test_classifier_separates():
    bias, weights = fit_classifier([([], 0.01, 900.0), ([0], 0.99, 50.0), ([1], 0.02, 50.0), ([0, 1], 0.98, 5.0)], 2)
    assert bias < 0 < bias + weights[0] and bias + weights[1] < 0
