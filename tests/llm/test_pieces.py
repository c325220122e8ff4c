import random
import struct

import pytest
import sentencepiece

from annoweave.llm import counts, encode, pieces, queries
from llm.brute import SF_SMALL

RAW = open(queries.MODEL_PATH, "rb").read()
ODD = ["  a   b", "a\tb\nc  ", " ", "", "\n\n", "aaaaaaaaaaaaaaaa  aaaa", "日本語 テスト 😀😀", "<0x0A> <s> <unk>",
       "   \n   x", "....... ---- ====", "1234567890 1.234.567", "x" * 3000, "ab" * 2000, "the " * 4000,
       "for(int i=0;i<n;i++){return a[i]!=b;}", "\x00\x01 \x7f", "ÀÉÎ õü ß"]


def message(number, body):
    size, out = len(body), b""
    while size > 127:
        out += bytes([size & 127 | 128])
        size >>= 7
    return bytes([number << 3 | 2]) + out + bytes([size]) + body


def as_unigram():
    """The same vocabulary as a unigram model.

    Scores of a thousand millions become small ones: single precision would round all others away.
    """
    model, out = pieces.parse_model(RAW), b""
    for piece, score, kind in zip(model.pieces, model.scores, model.types):
        out += message(1, message(1, piece.encode()) + b"\x15" + struct.pack("<f", max(score, -40_000.0))
                       + bytes([3 << 3, kind]))
    for number, body in pieces._fields(RAW):
        if number == 2:
            body = body.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01")
        if number > 1:
            out += message(number, body)
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    return [r.text for r in rows] + ODD


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_ids_counts_and_round_trip_of_the_given_model(spark, texts):
    model = pieces.parse_model(RAW)
    assert model.kind == pieces.BPE
    library = sentencepiece.SentencePieceProcessor(model_proto=RAW)
    df = frame(spark, texts)
    ids = {r.doc_id: r.ids for r in encode.encode(df, model).collect()}
    assert [ids[i] for i in range(len(texts))] == library.encode(texts)
    n = {r.doc_id: r.n_tokens for r in counts.count_tokens(df, model).collect()}
    assert [n[i] for i in range(len(texts))] == [len(ids[i]) for i in range(len(texts))]
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(df, model), model).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert [library.decode(ids[i]) for i in range(len(texts))] == texts


def test_unigram_words_equal_the_library_s(texts):
    raw = as_unigram()
    model = pieces.parse_model(raw)
    assert model.kind == pieces.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    cut = pieces.Cutter(model)
    words = sorted({w for t in texts for w in cut(t) if len(w) < 60 and w.startswith(pieces.MARK) and len(w) > 1})
    codes = [list(memoryview(c).cast("i")) for c in encode.best_codes(model, words, encode._Coded(model))]
    assert codes == library.encode([w[1:].replace(pieces.MARK, " ") for w in words])
    assert list(counts.best_counts(model, counts.automaton(model), words)) == [len(c) for c in codes]


def small_model(kind, byte_fallback=False):
    """Single letters and a few words, with ties."""
    found = ["<unk>", "<s>", "a", "b", "c", "ab", "bc", "abc", pieces.MARK, pieces.MARK + "a", "aa", "aaa"]
    scores = [0, 0, -4, -4, -4, -6, -6, -10, -3, -5, -8, -12]
    types = [pieces.UNKNOWN, pieces.CONTROL] + [pieces.NORMAL] * 10
    if byte_fallback:
        found += [f"<0x{b:02X}>" for b in range(256)]
        scores += [0] * 256
        types += [pieces.BYTE] * 256
    return pieces.Model(found, list(map(float, scores)), types, kind, True, byte_fallback)


def brute_best(model, word):
    """Best score over all segmentations; of equal ones, that whose last pieces are longest."""
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            i = model.ids.get(word[start:end])
            if i is None and start == end - 1:
                options.append((best[start][0] + model.unknown_score, best[start][1] + [word[start:end]]))
            elif i is not None:
                options.append((best[start][0] + model.scores[i], best[start][1] + [word[start:end]]))
        best.append(max(options, key=lambda o: o[0]))  # the first of equals: the longest last piece
    return best[-1][1]


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_ties_and_unknown_characters(byte_fallback):
    model = small_model(pieces.UNIGRAM, byte_fallback)
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("aabbccdé" + pieces.MARK) for _ in range(rng.randint(1, 12))) for _ in range(400)})
    want = [[i for t in brute_best(model, w) for i in model.spelled(t)] for w in words]
    codes = [list(memoryview(c).cast("i")) for c in encode.best_codes(model, words, encode._Coded(model))]
    assert codes == want
    assert list(counts.best_counts(model, counts.automaton(model), words)) == [len(w) for w in want]


def test_runs_and_order_do_not_matter(spark, texts, monkeypatch):
    model = pieces.parse_model(RAW)
    df = frame(spark, texts[:40])
    whole = sorted((r.doc_id, r.ids) for r in encode.encode(df, model).collect())
    again = sorted((r.doc_id, r.ids) for r in encode.encode(df.orderBy("text").repartition(5), model).collect())
    assert whole == again
    words = sorted({w for t in texts[:40] for w in pieces.Cutter(model)(t)})
    rule, coded = pieces.Merged(model), encode._Coded(model)
    together = dict(zip(words, encode.merged_codes(model, rule, words, coded)))
    assert all(next(encode.merged_codes(model, rule, [w], coded)) == together[w] for w in words[:500])


def test_nulls_repeats_and_columns(spark, docs, cluttered, nothing):
    model = pieces.parse_model(RAW)
    ids = encode.encode(cluttered, model, ("doc_id", "ids", "rank"))
    assert ids.columns == ["doc_id", "rank", "ids"]
    rows = ids.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r.ids for r in rows}
    assert by[300] is None and by[301] == []
    n = counts.count_tokens(cluttered, model).where("doc_id in (300, 301)")
    assert [r.n_tokens for r in n.collect()] == [0, 0]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [99_999_999, None, 264])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in encode.decode(odd, model).collect()} == {1: None, 2: "", 3: "a"}
    assert encode.encode(nothing, model).collect() == [] == counts.count_tokens(nothing, model).collect()


def test_unsupported_models_are_refused():
    spanning = ("a" + pieces.MARK + "b").encode()
    with pytest.raises(ValueError):
        pieces.parse_model(RAW + b"\x0a" + bytes([len(spanning) + 2]) + b"\x0a" + bytes([len(spanning)]) + spanning)
    with pytest.raises(ValueError):
        pieces.parse_model(RAW + b"\x1a\x02\x20\x01")  # removes extra white space
