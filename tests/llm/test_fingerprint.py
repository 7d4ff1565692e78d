import random
from statistics import mean

from pyspark.sql import functions as F

from brute import jaccard, sha, shingles
from fathom.llm.common import table
from fathom.llm.fingerprint import as_text, fingerprint, fingerprints_of_edits, likeness, next_ids

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, doc int, th int, fp string"


def edited(text, after):
    n = len(text) // 3
    return text[:len(text) - n] + after[:n]


def test_against_brute_force_on_documents(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(rows, reverse=True)
    out = fingerprints_of_edits(docs).withColumn("near_edited", likeness(F.col("fp"), F.col("edited_fp"))) \
        .withColumn("near_next", likeness(F.col("fp"), F.col("next_fp"))).collect()
    assert sorted(r.doc_id for r in out) == sorted(rows)
    off = []
    for r in out:
        nxt = rows[order[(order.index(r.doc_id) + 1) % len(order)]]
        assert r.n_chars == len(rows[r.doc_id])
        assert r.edited == edited(rows[r.doc_id], nxt)
        mine, theirs = shingles(rows[r.doc_id]), shingles(r.edited)
        off += [abs(r.near_edited - jaccard(mine, theirs)), abs(r.near_next - jaccard(mine, shingles(nxt)))]
    assert mean(off) < 0.02 and max(off) < 0.12, [(r.doc_id, rows[r.doc_id], r.edited, r.near_edited, r.near_next) for r, x in zip(out, off[::2]) if x > 0.1][:3]


def test_likeness_is_unbiased(frame):
    draw = random.Random(1)
    rows = []
    for i in range(60):
        size = draw.choice([12, 40, 200, 1500])
        a = [f"w{draw.randrange(10**6)}" for _ in range(size)]
        b = a[: size // 2] + [f"w{draw.randrange(10**6)}" for _ in range(size // 2)]
        rows.append((" ".join(a), " ".join(b)))
    df = frame(rows, "a string, b string").select("a", "b", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("j"))
    off = [r.j - jaccard(shingles(r.a), shingles(r.b)) for r in df.collect()]
    assert abs(mean(off)) < 0.02


def test_defined_cases(frame):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(5, "same words here and there again", None, 1, 1, ""), (4, "same words here and there again", None, 1, 1, ""),
            (3, None, "en", 1, 1, ""), (3, None, "en", 1, 1, ""), (2, "", "en", 1, 1, ""), (1, "two words", None, 1, 1, ""),
            (None, "no id", None, 1, 1, ""), (9, long, None, 1, 1, "")]
    out = fingerprints_of_edits(frame(rows, SCHEMA)).withColumn("f", as_text(F.col("fp"))).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 8 and got[5].f == got[4].f and got[3].f == got[2].f and got[1].f != got[2].f
    assert got[9].edited == edited(long, rows[0][1]) and got[1].edited == edited("two words", "no id")
    assert got[None].edited == edited("no id", long) and got[2].edited == ""
    assert fingerprints_of_edits(frame([], SCHEMA)).count() == 0
    one = fingerprints_of_edits(frame([(1, "abcdef", None, 1, 1, "")], SCHEMA)).first()
    assert one.edited == "abcdab"


def test_next_ids_over_many_ranges(spark):
    ids = [random.Random(2).randrange(10**9) for _ in range(5000)]
    got = {r.doc: r.next for r in next_ids(spark.createDataFrame([(i,) for i in set(ids)], "doc bigint")).collect()}
    order = sorted(set(ids), reverse=True)
    assert got == dict(zip(order, order[1:] + order[:1]))
