import random

import pytest

from fathom.llm.common import table
from fathom.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id bigint, text string, th int, doc int, first int, n int"


def brute(rows, length):
    seen, out = set(), []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            piece = data[s:s + length]
            if piece in seen:
                gone[s:s + length] = [True] * length
            seen.add(piece)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def run(df, **kw):
    return sorted(((r.doc, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(df, **kw).collect()),
                  key=lambda r: (r[0] is not None, r[0]))


def test_documents_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = run(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 100)
    assert sum(r[2] for r in got) > 10_000


@pytest.mark.parametrize("length, gram, letters, hot", [(20, 6, "ab", 20_000), (20, 6, "ab", 0), (20, 6, "abcdefgé", 20_000),
                                                        (20, 6, "abcdefgé", 3), (30, 12, "a", 20_000), (16, 16, "abc", 2)])
def test_repetitive_texts(frame, length, gram, letters, hot):
    draw = random.Random(11)
    bits = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 60))) for _ in range(12)]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randrange(12)))) for i in range(60)]
    assert run(frame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA), length=length, gram=gram, hot=hot) == brute(rows, length)


def test_defined_cases(frame):
    draw = random.Random(12)
    text = "".join(draw.choice("abcdefghij") for _ in range(400))
    long = "".join(draw.choice("abcdefghij ") for _ in range(2_500_000))
    run_of_one = "a" * 2_500_000
    rows = [(5, text), (5, text), (4, None), (3, ""), (2, "x" * 99), (1, "x" * 300), (None, text[:150]), (7, text[100:] + "tail"), (8, long), (9, long[5:]), (10, run_of_one)]
    got = run(frame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA))
    want = brute(rows[:8], 100)
    want += [(8, len(long), 0, 0, long.encode()), (9, len(long) - 5, len(long) - 5, 1, b""),
             (10, len(run_of_one), len(run_of_one) - 1, 1, b"a")]
    assert [r for i, r in enumerate(got) if i == 0 or r != got[i - 1]] == want and len(got) == len(rows)
    assert run(frame([], SCHEMA)) == []
    same_id = run(frame([(1, text, 1, 2, 3, 4), (1, text + "more", 1, 2, 3, 4)], SCHEMA))
    assert sorted(r[2] for r in same_id)[0] == 0 and sum(r[2] > 0 for r in same_id) == 1
