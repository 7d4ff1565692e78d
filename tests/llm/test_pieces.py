import numpy as np
import pytest
import sentencepiece

from fathom.llm import pieces as P
from fathom.llm.common import table

SCHEMA = "doc_id bigint, text string, word string, ids string, chunk int"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def run(df, **kw):
    return [(r.doc, np.frombuffer(r.ids, np.int32).tolist(), r.text) for r in P.encode_decode(df, **kw).collect()]


def test_documents_as_the_library(spark, model):
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = run(table(spark, "/root/testdata/sf0.01", "documents"))
    assert len(got) == len(docs)
    for doc, ids, text in got:
        assert text == docs[doc] and ids == model.encode(docs[doc])


def test_hard_texts(frame, model):
    texts = ["  Hello  world \n\n foo\t é 😀 x ", " ", "\n", "ｆｕｌｌ ﬁ ", "aaaaaaaaaaaa" * 4, "a" * 61, "the" * 5000, "=" * 3000, " " * 200, "x" * 100_000 + " y",
             "▁marked ▁", "<s> <unk> <0x0A> </s>", "!!!!????----", "á ‍ \x00 end", "internationalization" * 3, "1234567890" * 6] + \
        ["".join(chr(33 + (i * k) % 90) for i in range(59 + k % 3)) for k in range(1, 30)]
    got = dict((d, (ids, text)) for d, ids, text in run(frame([(i, t, "w", "i", 1) for i, t in enumerate(texts)], SCHEMA), chunk=2000))
    for i, t in enumerate(texts):
        assert got[i] == (model.encode(t), t.replace(P.MARK, " ")), t[:50]


def test_queue_and_fold_agree(spark, model):
    known, first_byte = P.model_pieces()
    words = ["▁internationalization", "▁" * 13, "▁xyzzy😀é", "aaaaaaaaaaaaaaaaaaa", "▁the", "éèçê", "▁Nebukadnezar's", "==--==--=="]
    pieces = spark.createDataFrame(known, "piece string, id int, rank int")
    rows = spark.createDataFrame([(7, i, w, None) for i, w in enumerate(words)], "chunk long, number int, word string, chunk_data string")
    r = P.segmented(P.lattice(rows, pieces.where("length(piece) > 1"), 16)).first()
    masks = np.full(len(words), (1 << 62) - 1, np.int64)
    masks[r.numbers] = r.masks
    table = {p: (i, r) for p, i, r in known}
    ids, ends = P.ids_of_words(words, masks, table, first_byte, 40_000)
    got = {w: ids[a:z].tolist() for w, a, z in zip(words, ends[:-1], ends[1:])}
    assert got == {w: P.merge_long(w, table, first_byte) for w in words}


def test_defined_cases(frame):
    rows = [(None, "no id", "w", "i", 1), (1, None, "w", "i", 1), (1, "", "w", "i", 1), (2, "twice", "w", "i", 1), (2, "twice", "w", "i", 1), (2, "other", "w", "i", 1)]
    got = run(frame(rows, SCHEMA))
    assert sorted((d is not None, d, t) for d, _, t in got) == sorted((d is not None, d, t or "") for d, t, *_ in rows)
    assert all(ids == [] for d, ids, _ in got if d == 1)
    assert run(frame([], SCHEMA)) == []
    # equal chunks
    same = run(frame([(None, "the same words", "w", "i", 1)] * 6, SCHEMA), chunk=5)
    assert len(same) == 6 and len({(tuple(ids), t) for _, ids, t in same}) == 1


def test_the_model_is_a_setting(frame, spark, model, tmp_path):
    spark.conf.set(P.MODEL_SETTING, str(tmp_path / "none.model"))
    try:
        with pytest.raises(FileNotFoundError, match=P.MODEL_VARIABLE):
            P.encode_decode(frame([(1, "a", "w", "i", 1)], SCHEMA))
    finally:
        spark.conf.unset(P.MODEL_SETTING)


def test_chunks_are_freed_when_they_are_closed():
    """Without the cycle collector, the tables of earlier chunks must not stay."""
    import gc
    from collections import defaultdict
    import pyarrow as pa
    from fathom.llm import pieces as P
    pairs = np.array(sorted(ord(a) << 32 | ord(b) for a, b in ("ab", "bc")), np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([f"abc word{i} abc" for i in range(40)])], names=["doc", "text"])
    gc.collect()
    before = sum(isinstance(x, defaultdict) for x in gc.get_objects())
    gc.disable()
    try:
        assert sum(1 for _ in P._to_chunks(10, pairs)([batch])) == 40
        assert sum(isinstance(x, defaultdict) for x in gc.get_objects()) <= before + 4
    finally:
        gc.enable()
