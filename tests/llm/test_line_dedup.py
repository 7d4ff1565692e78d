import random

import duckdb
import pandas as pd

from brute import sha
from fathom.llm.line_dedup import SQL, line_dedup, without_lines

SCHEMA = "doc_id bigint, text string, pos int, line string, th int"


def run(frame, rows):
    out = line_dedup(frame([(*r, 1, "clash", 2) for r in rows], SCHEMA)).collect()
    return {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out}, len(out)


def test_against_sql(frame):
    draw = random.Random(8)
    word = lambda: f"w{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}"
    bases = [[word() for _ in range(n)] for n in (1, 3, 4, 6, 9, 14, 20) for _ in range(4)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(draw.randrange(8)):
            base = list(draw.choice(bases))
            for _ in range(draw.choice([0, 0, 1, 2, 5])):
                base[draw.randrange(len(base))] = draw.choice([word(), str(draw.randrange(99)), f"id={draw.randrange(9)}"])
            lines.append(draw.choice(["", " ", "\t"]) + " ".join(base) + draw.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines + [""] * draw.randrange(3))))
    got, _ = run(frame, rows)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = set(c.execute(SQL).fetchall())
    assert {(d, n, k, sha(t)) for d, t, n, k in got} == want
    assert sum(k for _, _, k, _ in want) > 100


def test_templates_recur(frame):
    rows = [(i, f"own text number of {chr(97 + i) * 5} here\nPosted by user{i} on 2024-01-{i + 10} at noon by the gate\nSee the page of {'abcdefg'[i] * 4} for more about it") for i in range(7)]
    got, _ = run(frame, rows)
    kept = {d: t.split("\n") for d, t, _, _ in got}
    assert kept[0] == rows[0][1].split("\n")
    assert all(len(kept[d]) == 1 for d in range(1, 7)), kept


def posts(family, n, start):
    """Documents of one line each: names without digits, then the family's words."""
    return [(start + i, f"Posted in the forum by {'n' + chr(97 + start // 100) + chr(97 + i) * 4} {family} today") for i in range(n)]


def test_several_templates_of_a_leaf(frame):
    families = ["about old ships", "with new maps", "from far towns"]
    for some, sizes in ((families[:2], (22, 18)), (families, (20, 20, 20)), (families, (26, 8, 6))):
        rows = [r for k, f in enumerate(some) for r in posts(f, sizes[k], 100 * k)]
        got, _ = run(frame, rows)
        assert {d for d, t, _, k in got if not k} == {100 * k for k in range(len(some))}
    # a line of over half a leaf does not hide a family
    hot = [(1000 + i, "Posted in the forum by nobody in no place ever") for i in range(50)]
    got, _ = run(frame, hot + posts(families[0], 20, 0) + posts(families[1], 8, 100))
    assert {d for d, t, _, k in got if not k} == {0, 100, 1000}
    # lines that do not recur stay
    got, _ = run(frame, posts(families[0], 20, 0) + posts(families[1], 4, 100))
    assert {d for d, t, _, k in got if not k} == {0, 100, 101, 102, 103}


def test_defined_cases(frame):
    line = "one line of boilerplate text"
    rows = [(None, line)] + [(i, f"{line}\n\n  \n{'x' * (i + 1)}") for i in range(5)] + [(6, line), (6, line), (6, line + "\n" + line), (7, None), (8, ""),
                                                                                          (9, "\n".join(["same"] * 50_000))]
    got, n = run(frame, rows)
    assert n == len(rows)
    assert (None, line, 1, 0) in got and (0, "\n  \nx", 4, 1) in got and (6, "", 1, 1) in got and (6, "", 2, 2) in got
    assert (7, "", 1, 0) in got and (8, "", 1, 0) in got and (9, rows[-1][1], 50_000, 0) in got
    assert run(frame, []) == (set(), 0)
    kept = without_lines(frame([(1, "a", 5, "b", 7)], SCHEMA)).drop("__n_lines", "__n_dropped").collect()
    assert [tuple(r) for r in kept] == [(1, "a", 5, "b", 7)]
