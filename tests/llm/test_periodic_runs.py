import random
import re
import zlib

import numpy as np

from brute import sha
from fathom.llm import periodic_runs
from fathom.llm.periodic_runs import COVER, MODULUS, Extensions, find_runs, op13_periodic_runs, with_planted_period

SCHEMA = "doc_id bigint, text string, runs int, collapsed string, doc int"


def run(frame, rows, **options):
    out = periodic_runs.periodic_runs(frame([(*r, 1, "x", 2) for r in rows], SCHEMA), **options).collect()
    return sorted(((r.doc, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out), key=repr)


def cut(text):
    return re.findall("[^ \t-\r]+", text or "")


def brute_runs(w, least=24, times=3):
    """All runs by their definition: maximal stretches of equality at each distance, the least period of each."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(rows, **options):
    out = []
    for d, t in rows:
        w = cut(t)
        runs = brute_runs(w, **options)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        out.append((d, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def texts(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        w = []
        while len(w) < draw.choice([0, 10, 60, 300]):
            base = [draw.choice("abcdefgh") for _ in range(draw.choice([1, 1, 2, 3, 7, 8, 9, 12, 40]))]
            base = base * draw.choice([1, 1, 2, 3, 4, 30])
            if draw.random() < 0.3:
                base[draw.randrange(len(base))] = "z"
            w += base[draw.randrange(3):] * draw.choice([1, 1, 1, 3])
        rows.append((i, "".join(x + draw.choice([" ", " ", "\n", "\t\x0b", "\r\x0c "]) for x in w)))
    return rows


def test_the_cover_reaches_every_difference():
    assert {(b - a) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


def test_extensions_against_comparison(monkeypatch):
    draw = random.Random(4)
    for size, letters in ((1, 1), (5, 1), (100, 1), (400, 2), (1000, 3)):
        w = [draw.randrange(letters) for _ in range(size)]
        if size == 1000:
            w = w[:90] * 11 + w
        seq = np.array(w + [letters], np.int32)
        pairs = [(i, j) for i in range(len(w)) for j in range(i + 1, len(w))]
        pairs = draw.sample(pairs, min(len(pairs), 4000))
        if not pairs:
            continue
        want = []
        for i, j in pairs:
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            want.append(k)
        i, j = np.array(pairs).T
        assert Extensions(seq)(i, j).tolist() == want
        # equal hashes of different blocks
        with monkeypatch.context() as m:
            m.setattr(periodic_runs, "mix", lambda h: h & np.uint64(0))
            assert Extensions(seq)(i, j).tolist() == want


def test_runs_against_brute_force(frame, monkeypatch):
    rows = texts(300, 1)
    want = brute(rows)
    assert run(frame, rows) == want
    assert sum(len(r[2]) for r in want) > 200
    assert run(frame, rows, least=30, times=2) == brute(rows, least=30, times=2)
    for name, value in (("WORDS", 200), ("PLACES", 64), ("SLICE", 32)):
        monkeypatch.setattr(periodic_runs, name, value)
    docs = [cut(t) for _, t in rows]
    number = {x: k for k, x in enumerate(sorted({x for w in docs for x in w}))}
    seq = np.array([x for k, w in enumerate(docs) for x in [*(number[y] for y in w), len(number) + k]], np.int32)
    size = np.array([len(w) for w in docs])
    begin = np.cumsum(size + 1) - size - 1
    start, end, q = find_runs(seq, begin, size)
    assert list(zip(start.tolist(), (end - start).tolist(), q.tolist())) == [
        (s + begin[k], n, p) for k, w in enumerate(docs) for s, n, p in brute_runs(w)]
    assert run(frame, rows) == want                          # many steps and slices


def test_long_periods_and_long_texts(frame):
    draw = random.Random(7)
    base = [f"w{draw.randrange(5000)}" for _ in range(3000)]
    rows = [(1, " ".join(base * 3 + base[:500])), (2, " ".join(base * 2)), (3, "a " * 150_000)]
    got = {r[0]: r for r in run(frame, rows)}
    assert (0, 9500, 3000) in got[1][2] and got[1][3] == " ".join(base)
    assert got[2][2] == [] and got[2][3] == rows[1][1]
    assert got[3][2] == [(0, 150_000, 1)] and got[3][3] == "a"


def test_defined_cases(frame):
    rows = [(None, "a " * 30), (None, None), (5, ""), (5, " \n"), (5, "a " * 30), (5, "a " * 30), (7, "x\x1cy \x85 z\xa0w")]
    assert run(frame, rows) == brute(rows)
    assert run(frame, []) == []


def test_query(frame, tmp_path, spark):
    rows = texts(200, 11) + [(1000 + i, None if i % 3 else "one two three four five six") for i in range(60)]
    frame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for d, t in rows:
        w, h = cut(t), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        want[d] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                   sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    out = op13_periodic_runs(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in out} == want
    assert len(out) == len(rows)
    planted = with_planted_period(frame([(None, "a b", 1, "", 2)], SCHEMA)).collect()
    assert [tuple(r) for r in planted] == [(None, "a b")]
