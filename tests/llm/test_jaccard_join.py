import random

import numpy as np
import pytest

from brute import jaccard, shingles
from fathom.llm import jaccard_join as J
from fathom.llm import wordhash as W
from fathom.llm.common import table
from fathom.llm.components import components

SCHEMA = "doc_id bigint, text string, tid binary, node string, comp int"


def brute(rows, similarity=0.8):
    sets = [shingles(t or "") for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and (rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= similarity - 1e-12)] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min([label[i], *(label[j] for j in near[i])])
            changed |= low != label[i]
            label[i] = low
    key = lambda x: (x is not None, x)
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c), key=key) for c in set(label)}
    return sorted(((rows[i][0], least[label[i]], len(near[i])) for i in range(len(rows))), key=lambda r: (key(r[0]), str(r)))


def run(df, **kw):
    key = lambda x: (x is not None, x)
    return sorted(((r.doc, r.class_id, r.n_links) for r in J.jaccard_classes(df, **kw).collect()), key=lambda r: (key(r[0]), str(r)))


def test_documents_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("limit, block", [(200, 256), (3, 4)])
def test_edited_copies_and_small_limits(frame, limit, block):
    draw = random.Random(9)
    rows = []
    for base in range(12):
        words = [f"w{draw.randrange(10**5)}" for _ in range(draw.choice([8, 40, 150]))]
        for _ in range(draw.randrange(1, 12)):
            copy = list(words)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**5)}"
            rows.append((len(rows), " ".join(copy)))
    assert run(frame([(*r, None, "", 1) for r in rows], SCHEMA), limit=limit, block=block, recall=0.999999) == brute(rows)


def test_defined_cases(frame):
    long = " ".join(f"t{i}" for i in range(80_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A, b c d e F!"), (None, "a b c d e f"), (3, None), (4, ""), (5, "..."), (6, "two words"),
            (7, "Two words"), (8, long), (9, long + " end"), (1, "another text of id one")]
    assert run(frame([(*r, None, "", 1) for r in rows], SCHEMA)) == brute(rows)
    assert run(frame([], SCHEMA)) == [] and run(frame([(1, "x", None, "", 1)], SCHEMA)) == [(1, 1, 0)]


def test_runs_reach_the_recall():
    # a pair of similarity 0.8 agrees in each coordinate with probability 0.8
    draw = np.random.default_rng(4)
    pairs = 400
    a = draw.integers(0, 2 ** 16, (pairs, J.COORDS)).astype(np.uint16)
    b = np.where(draw.random((pairs, J.COORDS)) < 0.8, a, a + 1)
    met = np.zeros(pairs, bool)
    for r in range(J.runs_for(J.RECALL, 0.8, J.LEVELS)):
        sides = [[{int(W.mix(np.array([r + 1], np.uint64))[0])} for _ in range(pairs)] for _ in "ab"]
        for _ in range(J.LEVELS):
            for k in range(pairs):
                both = sides[0][k] & sides[1][k]
                for side, low in zip(sides, (a, b)):
                    node = np.array(sorted(both), np.uint64)
                    side[k] = {int(c) for rows, at in J._chosen(node, 0.8) for c in J._child(node[rows], at, low[k][at].astype(np.uint64))}
        met |= np.array([bool(x & y) for x, y in zip(*sides)])
    assert met.mean() >= 0.99


def test_components_of_chains_and_stars(spark):
    draw = random.Random(10)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in {y for e in edges for y in e if e[0] != e[1]}}
