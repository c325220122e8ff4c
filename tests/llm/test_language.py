import math
import zlib

import pytest

from annoweave.llm import language
from llm.brute import SF_SMALL


def brute_cost(counts, lang, context, byte):
    """Bits of one byte by the definition: escape from the longest context down."""
    bits = 0.0
    for start in range(len(context) + 1):
        followers = {g[-1:]: n for (name, g), n in counts.items() if name == lang and g[:-1] == context[start:]}
        if not followers:
            continue
        whole = sum(followers.values()) + len(followers)
        if byte in followers:
            return bits + math.log2(whole / followers[byte])
        bits += math.log2(whole / len(followers))
    return bits + 8.0


def test_cost_is_the_exact_code_length():
    counts = {}
    for lang, words in {"a": ["abra", "cad", "abra"], "b": ["bbb", "abb"]}.items():
        for word in words:
            for gram in language._grams(word.encode()):
                for start in range(len(gram)):
                    key = (lang, gram[start:])
                    counts[key] = counts.get(key, 0) + 1
    trees = language.Trees((lang, gram, n) for (lang, gram), n in counts.items())
    assert trees.languages == ["a", "b"]
    for gram in [b" a", b" abr", b"abrac", b"zzzzz", b" q", b"bb ", b"abb "]:
        want = [brute_cost(counts, lang, gram[:-1], gram[-1:]) for lang in "ab"]
        assert trees.cost(gram) == pytest.approx(want)
    # With the escape, the chances of all bytes after a context never exceed one.
    assert sum(2 ** -trees.cost(b" ab" + bytes([c]))[0] for c in range(256)) <= 1.0 + 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 30
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97


def test_odd_texts(docs, cluttered):
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    for d in (300, 301, 302, 305, 309):
        assert (found[d].lang_pred, found[d].score) == ("und", 0.0)
    assert found[0].lang_pred == "de" and found[1].lang_pred == "en"
    assert all(0.0 <= r.score <= 1.0 for r in found.values())
    assert found[None].held_out is False
    assert language.identify(docs).count() == docs.count() == language.identify(cluttered).count()


def test_unlabelled_text_and_keys_change_nothing(spark, docs):
    trees = language.learn(docs.where("text is not null and lang is not null and doc_id < 60"))
    rows = docs.selectExpr("doc_id + 5000 doc_id", "text", "'xx' lang", "'other' source")
    a = sorted(map(repr, ((r.lang_pred, r.score) for r in language.predict(docs, trees).collect())))
    b = sorted(map(repr, ((r.lang_pred, r.score) for r in language.predict(rows, trees).collect())))
    assert a == b


def test_nothing_to_learn_from(spark, docs, nothing):
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in language.identify(unlabelled).collect()} == {("und", 0.0)}
    assert language.identify(nothing).collect() == []


def test_kept_columns_give_way(cluttered):
    trees = language.learn(cluttered.where("doc_id < 60 and lang is not null"))
    found = language.predict(cluttered, trees, ("doc_id", "score", "rank"))
    assert found.columns == ["doc_id", "rank", "lang_pred", "score", "bits_per_byte"]
