import duckdb
import numpy as np
import pandas as pd
import sentencepiece

import corpus_pipeline as C
from brute import jaccard, shingles
from fathom.llm import decontaminate, line_dedup, pieces
from fathom.llm.toxicity import toxicity
from fathom.llm.common import table

SF = "/root/testdata/sf0.001"


def classes(rows):
    """Least id of each row's class, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    while True:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return [min(rows[k][0] for k in range(len(rows)) if label[k] == c) for c in label]


def test_run_against_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    toxic = {r.doc for r in toxicity(docs, labels).collect() if r.predicted}
    left = pd.DataFrame([(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic], columns=["doc_id", "text"])
    c = duckdb.connect()
    c.register("docs", left)
    c.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    lines = f"""WITH {line_dedup.LINES_SQL} SELECT doc_id,
        array_to_string(list_filter(ls, lambda x, i: gone IS NULL OR NOT list_contains(gone, (i - 1)::INT)), chr(10)) AS text
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM docs) LEFT JOIN ld_drops USING (doc_id)"""
    rows = sorted(c.execute(lines).fetchall())
    kept = [r for r, k in zip(rows, classes(rows)) if r[0] == k]
    c.register("documents", pd.DataFrame(kept, columns=["doc_id", "text"]))
    leaks = {r[0] for r in c.execute(decontaminate.SQL).fetchall()}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {d: (len(ids := model.encode(t)), ids, t) for d, t in kept if d not in leaks}
    got = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, np.int32).tolist(), r.text) for r in C.run(spark, SF).collect()}
    assert got == want and len(want) < len(left)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    clash = docs.selectExpr("doc_id", "text", "lang as th", "source as doc", "n_chars", "1 as item", "2 as pos", "3 as tid", "4 as entries")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and out.count() > 0


def test_stages_on_odd_rows(spark):
    schema = table(spark, SF, "documents").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "a text of one", "en", None, 13), (1, "a text of one", "en", None, 13),
                                 (1, "another text of one", "en", "s", 19), (2, "word " * 60_000, "en", "s", 300_000)], schema)
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in C.STAGES:
            assert stage(spark, docs, SF).count() == (n if name != "ngram_jaccard_join" else 4 if n else 0), name


def test_each_class_of_a_repeated_id_stays(spark):
    schema = table(spark, SF, "documents").schema
    a, b = "one two three four five six seven", "red green blue black white grey brown"
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1)], schema)
    assert sorted((r.doc_id, r.text) for r in C.drop_near_duplicates(spark, docs, SF).collect()) == [(1, a), (1, b)]
