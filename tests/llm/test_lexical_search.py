import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd

from fathom.llm import lexical_search
from fathom.llm.lexical_search import SQL, search

SCHEMA = "doc_id bigint, text string, doc int, term string, rank int"
ITEMS = "item_id bigint, text string, item int, score int"


def run(frame, rows, items, **options):
    out = search(frame([(*r, 1, "x", 2) for r in rows], SCHEMA), frame([(*r, 1, 2) for r in items], ITEMS), **options).collect()
    return [(r.item, r["rank"], r.doc, r.score) for r in out]


def brute(rows, items, k=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(d, Counter(cut(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def texts(n, seed):
    draw = random.Random(seed)
    vocabulary = ["a", "The", "the", "ÄRGER", "ärger", "日本", "x1", "1", "don't", "é", "İ", "ﬁ"] + [f"w{i}" for i in range(60)]
    return [(i, draw.choice(["", "!"]) + draw.choice([" ", ", ", "\n", "\x7f", "_"]).join(draw.choices(vocabulary, k=draw.choice([0, 1, 5, 30, 200])))) for i in range(n)]


def by_rank(found):
    return sorted(found, key=lambda x: (x[0] is None, x))


def test_against_brute_force_and_sql(frame, monkeypatch):
    rows, items = texts(300, 1), [(i, t) for i, t in texts(40, 2)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:60])]              # ties
    want = by_rank(brute(rows, items))
    assert len(want) > 300
    assert by_rank(run(frame, rows, items)) == want
    assert by_rank(run(frame, rows, items, block=200)) == want                  # several blocks of items
    for name, value in (("CELLS", 64), ("SLICE", 16), ("OCCURRENCES", 50), ("DOCS", 3)):
        monkeypatch.setattr(lexical_search, name, value)
    assert by_rank(run(frame, rows, items)) == want                              # many small rows of postings and steps
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    c.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert sorted(c.execute(SQL).fetchall()) == want


def test_few_documents(frame):
    rows, items = texts(6, 5), [(1, "the a 1"), (2, "absent words"), (3, "")]
    assert by_rank(run(frame, rows, items)) == by_rank(brute(rows, items))


def test_defined_cases(frame):
    long = "many words of a long text " * 60_000
    rows = [(None, "word here"), (5, "word here"), (5, "word here"), (3, "word here"), (7, None), (8, ""), (9, "..."), (10, long)]
    items = [(1, "WORD"), (1, "word"), (1, "word"), (2, None), (None, "long here")]
    got = run(frame, rows, items)
    want = brute(rows, items)
    assert by_rank(got) == by_rank(want)
    assert [x[2] for x in sorted(x for x in got if x[0] == 1)][:2] == [3, 3]    # two items of one id
    assert run(frame, [], items) == [] and run(frame, rows, []) == [] and run(frame, rows, [(1, None)]) == []
    assert run(frame, [(1, None)], [(1, "a")]) == []
