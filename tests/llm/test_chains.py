import random

import pytest

from fathom.llm import chains as C
from fathom.llm import wordhash as W
from fathom.llm.common import table

SCHEMA = "doc_id bigint, text string, seed int, th int, source string"


def run(frame, rows, **kw):
    return C.repeated_passages(frame([(*r, 1, 2, "x") for r in rows], SCHEMA), **kw).collect()


def text(draw, n):
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def best_chain_score(here, there, k, gap):
    score = []
    for i in range(len(here)):
        joined = [score[j] - gap * (here[i] - here[j] + there[i] - there[j]) for j in range(i) if here[j] < here[i] and there[j] < there[i]]
        score.append(k + max([0, *joined]))
    return max(score)


def test_chain_is_optimal():
    draw = random.Random(20)
    for _ in range(200):
        points = sorted({(draw.randrange(60), draw.randrange(60)) for _ in range(draw.randrange(1, 40))})
        here, there = zip(*points)
        top = C.chain(here, there, 8, 0.1)[0]
        x, y = [here[i] for i in top], [there[i] for i in top]
        assert all(a < b for a, b in zip(x, x[1:])) and all(a < b for a, b in zip(y, y[1:]))
        got = 8 * len(top) - 0.1 * (x[-1] - x[0] + y[-1] - y[0])
        assert abs(got - best_chain_score(here, there, 8, 0.1)) < 1e-9
        assert sorted(i for c in C.chain(here, there, 8, 0.1) for i in c) == list(range(len(points)))


def test_shared_runs_share_a_seed():
    draw = random.Random(21)
    for n in (C.K + C.WINDOW - 1, 24, 40):
        run_, a, b = text(draw, n), text(draw, 50), text(draw, 70)
        flat, first = W.word_hashes([" ".join(a + run_ + b), " ".join(b + run_), " ".join(run_)])
        grams = W.gram_hashes(flat, C.K)
        which, at = C.seeds_of(grams, first, C.K, C.WINDOW)
        found = [{int(g) for g in grams[at[which == t]]} for t in range(3)]
        assert found[0] & found[1] and found[0] & found[2]


def test_planted_passages(frame):
    draw = random.Random(22)
    passages = [text(draw, n) for n in (60, 80, 300)]
    rows, planted = [], {}
    for i in range(90):
        body, lead = text(draw, draw.randrange(20, 200)), draw.randrange(20)
        if i % 3 == 0:
            which = draw.randrange(3)
            copy = list(passages[which])
            for _ in range(len(copy) // 60):
                p = draw.randrange(len(copy))
                copy[p:p + 1] = draw.choice([[], ["new"], ["new", "words"]])
            body[lead:lead] = copy
            planted[i] = (which, lead, lead + len(copy))
        rows.append((i, " ".join(body)))
    got = run(frame, rows)
    first = {w: min(i for i, p in planted.items() if p[0] == w) for w, _, _ in planted.values()}
    assert {r.doc for r in got} == {i for i, p in planted.items() if first[p[0]] != i}
    assert all(r.source in planted and planted[r.source][0] == planted[r.doc][0] and r.source < r.doc for r in got)
    for i, (w, s, e) in planted.items():
        if first[w] != i:
            words = set()
            for r in got:
                if r.doc == i:
                    words |= set(range(r.start, r.end))
                    assert r.identity >= 0.8 and r.n_words >= 50
            assert len(words & set(range(s, e))) >= 0.8 * (e - s) and len(words - set(range(s, e))) <= 6


def test_documents_copies_are_found(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    seen, copies = {}, set()
    for r in sorted(docs.collect()):
        if r.text in seen and len(W.words_of(r.text)) >= C.MIN_WORDS:
            copies.add(r.doc_id)
        seen.setdefault(r.text, r.doc_id)
    assert copies and copies <= {r.doc for r in C.repeated_passages(docs).collect()}


def test_defined_cases(frame):
    p = " ".join(text(random.Random(23), 70))
    rows = [(None, p), (1, p), (1, p), (2, None), (3, ""), (4, "short text"), (5, "same " * 5000), (6, "same " * 5000), (1, "other words " + p),
            (7, " ".join(text(random.Random(24), 60_000)) + " " + p)]
    got = {(r.doc, r.source, r.start, r.end) for r in run(frame, rows)}
    assert got == {(1, None, 0, 70), (1, None, 2, 72), (7, None, 60_000, 60_070), (6, 5, 0, 5000)}
    assert run(frame, []) == []


def test_second_copy_in_one_text_is_found(frame):
    draw = random.Random(31)
    p, a, b = text(draw, 60), text(draw, 40), text(draw, 40)
    got = {(r.doc, r.source, r.start, r.end) for r in run(frame, [(1, " ".join(p)), (2, " ".join(a + p + b + p))])}
    assert got == {(2, 1, 40, 100), (2, 1, 140, 200)}


def test_passage_of_two_earlier_documents_is_found(frame):
    draw = random.Random(32)
    a, b, c, d = text(draw, 30), text(draw, 30), text(draw, 45), text(draw, 60)
    near = [*a[:12], "other", *a[13:]]
    rows = [(1, " ".join(text(draw, 20) + a)), (2, " ".join(b + text(draw, 20))), (3, " ".join(a + b)), (4, " ".join(a + b)),
            (5, " ".join(text(draw, 9) + near + b)), (6, " ".join(d + text(draw, 9) + c)), (7, " ".join(text(draw, 9) + d + a)), (8, " ".join(d + a))]
    got = {(r.doc, r.source, r.start, r.end) for r in run(frame, rows)}
    assert {(4, 3, 0, 60), (5, 3, 9, 69)} <= got
    words = {i for x, _, s, e in got if x == 8 for i in range(s, e)}
    assert words == set(range(90))


def test_no_stretch_of_an_earlier_document_is_lost(frame):
    """Every 50 words that an earlier text has word for word are covered: brute force over all pairs of texts made of few pieces."""
    draw = random.Random(33)
    pieces = [text(draw, n) for n in (7, 12, 19, 25, 26, 31, 38, 44, 49, 55)]
    texts = [[w for _ in range(draw.randrange(2, 9)) for w in draw.choice(pieces)[draw.randrange(3):]] for _ in range(60)]
    covered = {}
    for r in run(frame, [(i, " ".join(t)) for i, t in enumerate(texts)]):
        assert r.source < r.doc and r.n_words >= 50 and r.identity >= 0.8
        covered.setdefault(r.doc, set()).update(range(r.start, r.end))
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        grams = [tuple(t[a:a + 50]) for a in range(len(t) - 49)]
        expected[i] = {w for a, g in enumerate(grams) if g in seen for w in range(a, a + 50)}
        seen.update(grams)
    assert sum(map(len, expected.values())) > 1000
    assert all(words <= covered.get(i, set()) for i, words in expected.items())


def test_chain_of_too_many_differences_keeps_its_good_parts(frame):
    draw = random.Random(34)
    p, q = text(draw, 60), text(draw, 60)
    rows = [(1, " ".join(p + text(draw, 35) + q)), (2, " ".join(p + text(draw, 35) + q))]
    assert {(r.doc, r.source, r.start, r.end) for r in run(frame, rows)} == {(2, 1, 0, 60), (2, 1, 95, 155)}
