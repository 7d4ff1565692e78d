import random
import re
from collections import defaultdict

import duckdb
import pandas as pd

from brute import sha
from fathom.llm.exact_dedup import SQL, exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, len int, `first.row` int, norm string"


def run(frame, rows, **options):
    out = exact_dedup(frame([(*r, "clash", 1, 2, "x") for r in rows], SCHEMA), digests=True, **options).collect()
    return sorted((tuple(r) for r in out), key=repr)


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub("[ \t\n\x0b\x0c\r]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    return sorted(((d, min(g)[3], len(g), (x := (c, none, k, d)) == min(g), sha(n)) for n, g in groups.items() for c, none, k, d in g), key=repr)


def test_against_brute_force_and_sql(frame):
    draw = random.Random(3)
    head = "the same head of many texts that goes on for more than sixty-four characters "
    rows = []
    for i in range(400):
        body = draw.choice([head, ""]) + "".join(draw.choice("abé\U0001f600") for _ in range(draw.choice([0, 1, 2, 3, 80])))
        rows.append((i, "".join(c + draw.choice(["", "", " ", "\t", "\x0b", "\x0c", "\r", "\n"]) for c in body)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:50])]
    got = run(frame, rows)
    assert got == brute(rows)
    assert got == run(frame, rows, slots=1)                  # every document shares a slot with a survivor
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(c.execute(SQL).fetchall(), key=repr) == got
    assert sum(not r[3] for r in got) > 100


def test_other_white_space_counts(frame):
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "ab"), (5, "a\x1cb"), (6, "a\x85b")]
    assert {r[0]: r[2] for r in run(frame, rows)} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}


def test_digests_of_survivors_only(frame):
    rows = [(1, "one text"), (2, "onetext"), (3, "another text")]
    out = {r.doc: r.digest for r in exact_dedup(frame([(*r, "", 1, 2, "") for r in rows], SCHEMA)).collect()}
    assert out == {1: sha("onetext"), 2: sha("onetext"), 3: None}


def test_defined_cases(frame):
    long = "word " * 200_000
    rows = [(None, "same"), (None, "s a m e"), (4, "sam e"), (4, "sam e"), (7, None), (8, ""), (9, " \n"), (10, long), (11, long.strip())]
    got = run(frame, rows)
    assert len(got) == len(rows)
    assert sum(r[3] for r in got) == 3
    assert {(r[0], r[1], r[2], r[3]) for r in got} == {(None, None, 4, True), (None, None, 4, False), (4, None, 4, False),
                                                       (7, 9, 3, False), (8, 9, 3, False), (9, 9, 3, True), (10, 10, 2, True), (11, 10, 2, False)}
    tied = run(frame, [(4, "sam e"), (4, "sam e"), (None, "sa me"), (3, "other")])
    assert sorted((r[0] or 0, r[1], r[3]) for r in tied) == [(0, 4, False), (3, 3, True), (4, 4, False), (4, 4, True)]
    assert run(frame, []) == []
