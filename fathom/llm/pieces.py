"""SentencePiece encoding and decoding over a relational lattice.

A text falls into words (a run of word marks, U+2581, and the characters up to
the next mark), and words are cut wherever no piece holds the two neighbouring characters; no
piece spans such a cut, so what is between two cuts is encoded on its own. Documents are read
once into chunks: the distinct words of each, and the texts as packed numbers of
words. Chunks are dealt once by their number, the only exchange; all that follows
stays with its chunk. For every distinct word of a chunk the substrings of at most the
longest piece's length are exploded and joined to the piece table on their
text; the matches are the edges of the word's lattice. Gathered by chunk, they are sorted
by word and score, and each word's edges are folded by higher-order functions into the
boundaries of its segmentation, which the chunk's ids are read from.

The fold: the model at hand merges pairs (BPE), and its scores are the order
of merges. One pass over the edges, best score and then leftmost first, joins two
neighbouring segments wherever an edge covers just these; a Viterbi sum over
the same lattice would give other ids than the model. The state is one bit for
each boundary. Words of more than ``LONGEST`` characters do not fit and words
without any piece have no edges: both are encoded by the same rule with a
queue in Python (``merge_long``); nothing is cut off. Characters without a
piece become the ids of their bytes.

Only the piece table is broadcast: its size is the model's (32,000 rows).

Defined cases: null and empty texts have no ids; the word mark itself reads
back as a blank, as in the model; each row of the input gets a row, repeated
and null ids included; extra columns are left behind.
"""

from __future__ import annotations

import heapq
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.llm.catalog import register
from fathom.llm.common import documents, short_batches, ship, table

#: The model file, a path that the driver can read: from this setting of the session, else of the environment, else the default.
MODEL_SETTING, MODEL_VARIABLE, MODEL = "spark.fathom.piece.model", "FATHOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONGEST = 60
#: Characters of the documents of a chunk.
CHUNK = 1 << 21
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path(spark: SparkSession) -> str:
    return spark.conf.get(MODEL_SETTING, None) or os.environ.get(MODEL_VARIABLE) or MODEL


def model_pieces(model: str = MODEL) -> tuple[list[tuple[str, int, int]], int]:
    """``(piece, id, rank)`` of a model's ordinary pieces by falling score, and the id of the byte piece <0x00>."""
    import sentencepiece
    if not os.path.isfile(model):
        raise FileNotFoundError(f"no SentencePiece model at {model}: set {MODEL_SETTING} or {MODEL_VARIABLE}")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    pieces = [(sp.id_to_piece(i), i, rank) for rank, i in enumerate(ids)]
    if any(not re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p, _, _ in pieces):
        raise ValueError("pieces that go on over a blank are not supported")
    return pieces, sp.piece_to_id("<0x00>")


def pair_codes(pieces) -> np.ndarray:
    """The neighbouring characters that some piece holds, as sorted numbers."""
    pairs = {p[i:i + 2] for p, *_ in pieces for i in range(len(p) - 1)}
    return np.array(sorted(ord(a) << 32 | ord(b) for a, b in pairs), np.uint64)


def cut(words: list[str], pairs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All words cut wherever no piece holds the two neighbouring characters, and the number of parts of each."""
    if not words:
        return [], np.zeros(0, np.uint32)
    flat = "".join(words)
    code = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    start = np.cumsum([0, *map(len, words)])
    both = code[:-1] << np.uint64(32) | code[1:]
    at = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
    begins = np.concatenate(([True], pairs[at] != both))
    begins[start[:-1]] = True
    place = np.append(np.flatnonzero(begins), len(flat))
    ends = place.tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], np.diff(np.searchsorted(place, start)).astype(np.uint32)


def _units(text: str) -> list[str]:
    """The words of a text, each with its marks."""
    if "  " in text or text[:1] == " " or text[-1:] == " " or MARK in text:
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []
    return (MARK + text.replace(" ", " " + MARK)).split(" ") if text else []


def _to_chunks(size: int, pairs: np.ndarray):
    """(doc, text) -> chunks of documents: their distinct cut words, and their texts as packed numbers of words."""
    def empty():
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__        # a new word gets the next number
        return number, [], [], []

    def work(batches):
        pack = zstandard.ZstdCompressor(level=3)
        (number, docs, counts, parts), held = empty(), 0

        def close():
            seq = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            cuts, sizes = cut(list(number), pairs)
            at: defaultdict = defaultdict()
            at.default_factory = at.__len__
            flat = np.fromiter(map(at.__getitem__, cuts), np.uint32, len(cuts))
            words = list(at)
            # a table that holds its own method is freed by the cycle collector only, which comes late
            number.default_factory = at.default_factory = None
            header = np.array([len(sizes), len(flat)], np.uint32)
            known = [d if d is not None else 0 for d in docs]
            return pa.RecordBatch.from_pydict({"words": [words], "docs": [np.array(known, np.int64).tobytes()],
                                 "null_docs": [np.array([d is None for d in docs]).tobytes()], "counts": [np.array(counts, np.int64).tobytes()],
                                 "seq": [pack.compress(b"".join(x.tobytes() for x in (header, sizes, flat, seq)))]},
                                              schema=pa.schema([("words", pa.list_(pa.string())), *((n, pa.binary()) for n in ("docs", "null_docs", "counts", "seq"))]))
        # a few rows of a batch at a time, to hold no batch twice
        for doc, text in ((d, t) for b in batches for k in range(0, b.num_rows, 128)
                          for d, t in zip(b.column(0).slice(k, 128).to_pylist(), b.column(1).slice(k, 128).to_pylist())):
            units = _units(text)
            parts.append(np.fromiter(map(number.__getitem__, units), np.uint32, len(units)))
            docs.append(doc)
            counts.append(len(units))
            held += len(text)
            if held >= size:
                yield close()
                (number, docs, counts, parts), held = empty(), 0
        if docs:
            yield close()
    return work


#: An edge is one long: number of the word in its chunk (32 bits), rank of the piece (20 bits), from and to (6 bits each).
def _field(edge: Column, low: int) -> Column:
    return F.shiftright(edge, low).bitwiseAND(F.lit(63)).cast("int")


def lattice(words: DataFrame, pieces: DataFrame, most: int) -> DataFrame:
    """``chunk, edges, chunk_data``: the pieces of two characters or more inside the words of each chunk as packed longs,
    a word's edges together, best score first, leftmost first. A chunk's last row carries its data instead of a word."""
    n = F.length("word")
    top = F.least(n - F.col("i"), F.lit(most))
    spans = words.select("chunk", "number", "word", "chunk_data", F.explode_outer(F.sequence(F.lit(0), n - 2)).alias("i")) \
        .select("chunk", "number", "word", "chunk_data", "i", F.explode_outer(F.sequence(F.lit(2), top)).alias("k")) \
        .select("chunk", "number", "chunk_data", "i", "k", F.expr("substring(word, i + 1, k)").alias("piece"))
    edges = spans.join(F.broadcast(pieces), "piece", "left").where("rank is not null or chunk_data is not null").select("chunk", "chunk_data", F.expr(
        "shiftleft(cast(number as bigint), 32) | shiftleft(cast(rank as bigint), 12) | shiftleft(cast(i as bigint), 6) | cast(i + k as bigint)").alias("e"))
    # chunks are dealt by their number, so their edges are grouped where they are
    return edges.groupBy("chunk").agg(F.sort_array(F.collect_list("e")).alias("edges"), F.first("chunk_data", True).alias("chunk_data"))


def _inner(e: Column, mask: Column) -> Column:
    """The boundaries strictly inside an edge."""
    one = F.lit(1).cast("bigint")
    return mask.bitwiseAND(F.call_function("shiftleft", one, _field(e, 0)) - F.call_function("shiftleft", one, _field(e, 6) + 1))


def _ends(e: Column, mask: Column) -> Column:
    return (F.getbit(mask, _field(e, 6)) == 1) & (F.getbit(mask, _field(e, 0)) == 1)


def fold(edges: Column) -> Column:
    """The boundaries (one bit each) of the segmentation of a word with these edges."""
    return F.aggregate(edges, F.lit((1 << 62) - 1), lambda mask, e: F.when(
        _ends(e, mask) & (F.bit_count(_inner(e, mask)) == 1), mask.bitwiseXOR(_inner(e, mask))).otherwise(mask))


def segmented(chunks: DataFrame) -> DataFrame:
    """``numbers`` of the words of a chunk that have edges, and the boundaries of each, ``masks``."""
    number = lambda i: F.shiftright(F.get("edges", i), 32)
    begins = F.filter(F.sequence(F.lit(0), F.size("edges") - 1), lambda i: (i == 0) | (number(i) != number(i - 1)))
    rows = chunks.withColumn("begins", F.when(F.size("edges") > 0, begins).otherwise(F.expr("cast(array() as array<int>)")))
    ends = F.transform("begins", lambda b, j: F.coalesce(F.get("begins", j + 1), F.size("edges")))
    rows = rows.withColumn("numbers", F.transform("begins", lambda b: number(b).cast("int"))).withColumn("ends", ends)
    return rows.withColumn("masks", F.zip_with("begins", "ends", lambda b, z: fold(F.slice("edges", b + 1, z - b))))


def spell_characters(flat: np.ndarray, ends: np.ndarray, known: dict, first_byte: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with those of characters (negative) put in: a piece of its own, else its bytes; and where each word now ends."""
    alone = np.unique(flat[flat < 0])
    parts = [[known[c][0]] if (c := chr(-1 - x)) in known else [first_byte + b for b in c.encode()] for x in alone.tolist()]
    table = np.concatenate([np.arange(top, dtype=np.int32), *[np.array(p, np.int32) for p in parts]])
    length = np.concatenate([np.ones(top, np.int64), np.array([len(p) for p in parts], np.int64)])
    start = np.cumsum(length) - length
    out, to = _gather(table, start, length, np.where(flat < 0, top + np.searchsorted(alone, flat), flat))
    return out, to[ends]


def ids_of_words(words: list[str], masks: np.ndarray, known: dict, first_byte: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and where each begins (one more at the end): the pieces between their boundaries.

    A word of more than LONGEST characters has no boundaries and takes the queue."""
    ids, sizes = [], []
    for at in range(0, len(words), 1 << 14):
        some = words[at:at + (1 << 14)]
        n = np.fromiter(map(len, some), np.int64, len(some))
        short = np.where(n <= LONGEST, n, 0)
        bits = np.unpackbits(masks[at:at + len(some)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, col = np.nonzero(bits[:, :LONGEST + 1].astype(bool) & (np.arange(LONGEST + 1) <= short[:, None]))
        start = np.cumsum(n) - n
        place = start[word] + col
        inside = col < short[word]
        flat = "".join(some)
        get = known.get
        cut = [flat[a:z] for a, z in zip(place[inside].tolist(), place[np.flatnonzero(inside) + 1].tolist())]
        found = np.fromiter((k[0] if (k := get(t)) else -1 - ord(t) for t in cut), np.int32, len(cut))
        count = np.bincount(word[inside], minlength=len(some))
        if (n > LONGEST).any():
            parts, upto = [], np.concatenate(([0], np.cumsum(count)))
            for i, w in enumerate(some):
                parts.append(found[upto[i]:upto[i + 1]] if n[i] <= LONGEST else np.array(merge_long(w, known, first_byte), np.int32))
            found, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        out, ends = spell_characters(found, np.concatenate(([0], np.cumsum(count))), known, first_byte, top)
        ids.append(out)
        sizes.append(np.diff(ends))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(size)))


def merge_long(word: str, pieces: dict[str, tuple[int, int]], first_byte: int) -> list[int]:
    """The fold for a word of any length: neighbours in a queue by score, then place."""
    left, right, text = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1)), list(word)
    queue: list = []

    def offer(i):
        j = right[i]
        if j < len(word) and (p := pieces.get(text[i] + text[j])):
            heapq.heappush(queue, (p[1], i, text[i], text[j]))
    for i in range(len(word) - 1):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = right[i]
        if text[i] != a or j >= len(word) or text[j] != b:
            continue
        text[i], text[j], right[i] = a + b, "", right[j]
        if right[j] < len(word):
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [k for t in text if t for k in ([pieces[t][0]] if t in pieces else [first_byte + x for x in t.encode()])]


def decode(ids: np.ndarray, begin: np.ndarray, data: np.ndarray, size: np.ndarray, at: np.ndarray) -> list[str]:
    """Texts of id sequences [begin[k], begin[k + 1]): the pieces' bytes one after another, without the first blank."""
    sizes = size[ids]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(ends[-1]) - np.repeat(ends[:-1] - at[ids], sizes)
    flat = data[place].tobytes()
    cut = ends[begin].tolist()
    return [flat[a:b].decode("utf-8", "replace").replace(MARK, " ")[1:] for a, b in zip(cut[:-1], cut[1:])]


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of flat one after another, and where each begins (one more at the end)."""
    n = length[which]
    ends = np.concatenate(([0], np.cumsum(n)))
    return flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - start[which], n)], ends


def _from_chunks(pieces: list[tuple[str, int, int]], first_byte: int):
    """Chunks with the boundaries of their words -> the documents' ids and decoded texts."""
    spelt = {i: p.encode() for p, i, _ in pieces} | {first_byte + x: bytes([x]) for x in range(256)}
    top = max(spelt) + 1
    size = np.array([len(spelt.get(i, b"")) for i in range(top)])
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    data = np.frombuffer(b"".join(spelt.get(i, b"") for i in range(top)), np.uint8)
    known = {p: (i, r) for p, i, r in pieces}

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from documents_of(b.slice(i, 1))

    def documents_of(one):
        """The documents of one chunk, some at a time."""
        words = one.column("words")[0].as_py()
        masks = np.full(len(words), (1 << 62) - 1, np.int64)
        masks[one.column("numbers").flatten().to_numpy(zero_copy_only=False)] = one.column("masks").flatten().to_numpy(zero_copy_only=False)
        flat, ends = ids_of_words(words, masks, known, first_byte, top)
        length = np.diff(ends)
        row = {n: one.column(n)[0].as_py() for n in ("docs", "null_docs", "counts", "seq")}
        store = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["seq"]), np.uint32)
        n_units, n_cuts = int(store[0]), int(store[1])
        cuts, parts, seq = np.split(store[2:], [n_units, n_units + n_cuts])
        # cut words to words
        ids, ends = _gather(flat, ends[:-1], length, parts)
        unit_ends = ends[np.concatenate(([0], np.cumsum(cuts, dtype=np.int64)))]
        start, length = unit_ends[:-1], np.diff(unit_ends)
        docs, null = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["null_docs"], bool)
        bounds = np.concatenate(([0], np.cumsum(np.frombuffer(row["counts"], np.int64))))
        step = max(1, 100_000 * len(docs) // max(1, len(seq)))
        for i in range(0, len(docs), step):
            j = min(len(docs), i + step)
            some, ends = _gather(ids, start, length, seq[bounds[i]:bounds[j]])
            begin = ends[bounds[i:j + 1] - bounds[i]]
            yield pa.RecordBatch.from_arrays([pa.array(docs[i:j], mask=null[i:j]), pa.array([some[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary()),
                                              pa.array(decode(some, begin, data, size, at), pa.string())], names=["doc", "ids", "text"])
    return work


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``doc, ids, text`` of every row: the ids as packed 32-bit integers, and the text that they decode to."""
    docs = documents(df, id_col, text_col)
    short_batches(df.sparkSession)
    known, first_byte = model_pieces(model or model_path(df.sparkSession))
    # pieces of one character join nothing: they are looked up in the end
    pieces = df.sparkSession.createDataFrame([p for p in known if len(p[0]) > 1], "piece string, id int, rank int")
    pairs = pair_codes(known)
    # the only exchange: every later step keeps a chunk's rows together
    data = "struct(words, docs, null_docs, counts, seq)"
    chunks = docs.mapInArrow(_to_chunks(chunk, pairs), "words array<string>, docs binary, null_docs binary, counts binary, seq binary") \
        .withColumn("chunk", F.monotonically_increasing_id()).repartition("chunk")       # equal chunks are chunks of their own
    # a row for each word, and one behind them with the chunk's data
    none = "cast(null as struct<words:array<string>,docs:binary,null_docs:binary,counts:binary,seq:binary>)"
    rows = chunks.select("chunk", F.posexplode(F.expr(
        f"concat(transform(words, w -> struct(w as word, {none} as chunk_data)), array(struct(cast(null as string) as word, {data} as chunk_data)))")).alias("number", "x")) \
        .select("chunk", "number", "x.word", "x.chunk_data").where(f"chunk_data is not null or length(word) between 2 and {LONGEST}")
    whole = segmented(lattice(rows, pieces, max(len(p) for p, _, _ in known)))
    return whole.select("chunk_data.*", "numbers", "masks").mapInArrow(_from_chunks(known, first_byte), "doc bigint, ids binary, text string")


@register("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    """Ids of every document, their number and digest, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents")
    out = encode_decode(docs)
    return out.select(F.col("doc").alias("doc_id"), F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


ship(__name__)
