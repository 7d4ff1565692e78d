import itertools
import random

from fathom.llm.common import documents
from fathom.llm.decontaminate import MASKS, SPAN, WINDOW, contaminated, overlaps

DOCS = "doc_id bigint, text string, item bigint, iw string, seed int"
ITEMS = "item bigint, text string, doc bigint"


def test_masks_keep_a_seed_under_any_two_substitutions():
    for subs in itertools.combinations(range(WINDOW), 2):
        assert any(not {o + p for p in m} & set(subs) for m in MASKS for o in range(WINDOW - SPAN + 1))


def found(frame, docs, items):
    out = overlaps(documents(frame([(*d, 1, "x", 1) for d in docs], DOCS)), frame([(*i, 9) for i in items], ITEMS)).collect()
    return {(r.doc, r.item): (r.start, r.agreeing, r.length) for r in out}


def text(draw, n):
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def test_planted_passages(frame):
    draw = random.Random(5)
    items = [text(draw, n) for n in (13, 20, 40, 59, 11, 10, 4, 1)]
    docs, expected = [], {}
    for k in range(120):
        which = draw.randrange(len(items))
        copy, subs = list(items[which]), draw.randrange(4)
        first = draw.randrange(max(1, len(copy) - WINDOW + 1))
        part = copy[first:first + WINDOW]
        for p in draw.sample(range(len(part)), min(subs, len(part))):
            part[p] = "changed"
        lead = text(draw, draw.randrange(60))
        docs.append((k, " ".join(lead + part + text(draw, draw.randrange(60))).title() + "."))
        if len(copy) >= WINDOW and subs <= 2:
            expected[k, which] = (len(lead), WINDOW - subs, WINDOW)
        elif len(copy) < SPAN and subs == 0:
            expected[k, which] = (len(lead), len(copy), len(copy))
        elif len(copy) >= WINDOW or len(copy) < SPAN:
            expected[k, which] = None
    got = found(frame, docs, [(i, " ".join(x)) for i, x in enumerate(items)])
    for key, want in expected.items():
        have = got.get(key)
        # a substitution at an end lets the window slip by as many words
        assert have == want or (have and want and have[1:] == want[1:] and abs(have[0] - want[0]) <= 2), key
    assert all(docs[d][1] and (d, i) in expected or len(items[i]) in (10, 11) for d, i in got)


def test_short_items_with_every_allowed_substitution(frame):
    draw, items, docs, want = random.Random(8), {n: text(random.Random(n), n) for n in range(5, WINDOW)}, [], {}
    for n, words in items.items():
        for subs in itertools.combinations(range(n), n - -(-n * 4 // 5)):
            copy = ["changed" if p in subs else w for p, w in enumerate(words)]
            want[len(docs), n] = (5, n - len(subs), n)
            docs.append((len(docs), " ".join(text(draw, 5) + copy + text(draw, 5))))
    assert found(frame, docs, [(n, " ".join(w)) for n, w in items.items()]) == want


def test_defined_cases(frame):
    passage = " ".join(text(random.Random(6), 30))
    long = " ".join(text(random.Random(7), 60_000)) + " " + passage
    docs = [(1, passage), (1, passage), (None, passage), (2, None), (3, ""), (4, "..."), (5, long), (6, passage + "\n\n" + passage), (1, "other text of this id")]
    got = found(frame, docs, [(0, passage), (0, passage), (7, None), (8, ""), (None, passage)])
    assert got == {(d, i): (60_000 if d == 5 else 0, 13, 13) for d in (1, None, 5, 6) for i in (0, None)}
    assert found(frame, [], [(0, passage)]) == {} and found(frame, docs, []) == {}
    row = contaminated(documents(frame([(1, passage, 1, "", 1)], DOCS)), frame([(0, passage, 1), (3, passage, 1)], ITEMS)).first()
    assert (row.n_items, row["items"], row.agreement) == (2, [0, 3], 1.0)
