from itertools import combinations
from pathlib import Path

from llm import brute
import numpy as np
import pyarrow as pa
import pytest

from annoweave.llm import similar
from annoweave.llm.components import components
from annoweave.llm.shingles import shingle_sets
from annoweave.session import shared_folder


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 50)])
def test_equals_all_pairs(docs, width, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(similar.join_similar(docs, width=width, percent=percent)) == sorted(
        brute.similar(rows, width, percent), key=repr)


def test_links_through_rows_without_an_id(spark):
    """Neither equal set links the outer two; the row between them does, whatever its id."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(w) for w in (["x", "y"] + words, ["x"] + words, words, words + ["z"], words[:-3] + ["q"])]
    alone = " ".join(f"v{i}" for i in range(30))
    for ids in ((1, None, None, None, 2), (None,) * 5, (2 ** 62 + 5, None, None, 2 ** 63 - 1, None), (4, 3, 2, 1, 0)):
        rows = [(i, t) for i, t in zip(ids, texts)] + [(None, alone), (None, alone + " u"), (None, None), (77, "")]
        rows += rows[1:3] * 40
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = sorted(brute.similar(rows, 5, 90), key=repr)
        assert found(similar.join_similar(df, width=5, percent=90)) == want
    assert {c for _, n, c in want if n > 40} == {0}


def test_extra_columns_change_nothing(docs, cluttered):
    assert found(similar.join_similar(cluttered)) == found(similar.join_similar(docs))


def test_empty_table(nothing):
    assert similar.join_similar(nothing).collect() == []


def test_large_groups_need_no_common_centre(spark):
    """Many documents share their frequent shingles; several separate groups, one a long chain."""
    rows = []
    for group in range(3):
        for i in range(60):
            words = [f"g{group}w{k}" for k in range(40)]
            words[(i * 2) % 40] = f"u{group}-{i}"  # two documents of a group differ in two places
            rows.append((group * 100 + i, " ".join(words + ["common passage of many words here"] * 3)))
    chain = [f"c{k}" for k in range(60)]
    for i in range(50):
        rows.append((1000 + i, " ".join(chain[:30 + i // 2] + [f"d{k}" for k in range(i // 2)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (70, 80, 90):
        assert found(similar.join_similar(df, width=2, percent=percent)) == sorted(
            brute.similar(rows, 2, percent), key=repr)


def test_shingle_sets_are_those_of_the_words():
    texts = ["The CAT the cat the cat", "the cat", "", None, "\t x\x0b y\x0cz ", "ÀB àb", "a" * 5000 + " b c d"]
    for width in (1, 2, 4):
        sets = [set(s.tolist()) for s in shingle_sets(pa.array(texts), width)]
        plain = [brute.shingles(t, width) for t in texts]
        names = {}
        assert [len(s) for s in sets] == [len(p) for p in plain]
        for s, p in zip(sets, plain):
            for other, q in zip(sets, plain):
                assert len(s & other) == len(p & q)
        assert names == {}
    sliced = pa.array(texts).slice(1, 3)
    assert [len(s) for s in shingle_sets(sliced, 1)] == [2, 0, 0]


def test_batches_do_not_matter():
    rng = np.random.default_rng(3)
    token = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(200, 20)]))
    doc = rng.permutation(len(token))
    columns = [token, doc, np.full(len(token), 50), np.zeros(len(token), dtype=np.int64)]

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i:i + size]) for c in columns], list("tdnp"))
                   for i in range(0, len(token), size)]
        out = [b.to_pylist() for b in similar._paired(80)(iter(batches))]
        return sorted({(r["token"], r["a"], r["b"]) for rows in out for r in rows}, key=repr)

    assert run(7) == run(33) == run(1) == run(10_000)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute.roots({n for link in links for n in link}, links)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exact_mode_counts_every_link(docs):
    """Near copies in groups of several blocks, classes of copies, rows without an id or with one id."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [brute.shingles(t, 4) for _, t in rows]

    def alike(x, y):
        return bool(x and y) and 100 * len(x & y) >= 85 * len(x | y)

    want = [(d, len(s), sum(alike(s, t) for t in sets) - bool(s)) for (d, _), s in zip(rows, sets)]
    got = similar.count_links(docs, width=4, percent=85, block=16)
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert max(n for _, _, n in want) >= 49


def test_exact_mode_pairs(docs, nothing):
    links, members = similar.exact_links(docs, width=4, percent=85, block=16)
    some = {frozenset(brute.shingles(r.text, 4)) for r in docs.collect()} - {frozenset()}
    assert members.count() == docs.count()
    assert members.where("class is not null").select("class").distinct().count() == len(some)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(a < b for a, b in pairs) and len(set(pairs)) == len(pairs)
    assert len(pairs) == sum(100 * len(x & y) >= 85 * len(x | y) for x, y in combinations(some, 2))
    assert similar.count_links(nothing).collect() == []


def scratch(spark):
    """What lies in the scratch folder, by name."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return {p.name: p for p in folder.rglob("annoweave-*")}


def test_sets_prefixes_and_pairs_go_before_the_result(spark, docs):
    """What grows with the shingles or the pairs is deleted by the step that needs it last."""
    before = set(scratch(spark))
    got = similar.join_similar(docs)
    left = {name.split("-", 1)[1].rsplit("-", 1)[0] for name in set(scratch(spark)) - before}
    assert "similar-slim" in left and not left & {
        "similar-frequent", "similar-prefixes", "similar-pairs", "similar-distinct", "similar-ids", "similar-orders",
        "similar-candidates", "similar-sets", "similar-links", "similar-remaining"}
    assert got.count() == docs.count()


def test_whole_sets_only_of_pairs_that_pass_the_orders(docs, monkeypatch):
    """The whole sets of documents that the first order alone brings together are not stored."""
    kept, store = {}, similar.stored

    def stored(df, label):
        kept[label] = store(df, label)
        if label in ("similar-candidates", "similar-sets", "similar-orders"):
            kept[label + " rows"] = kept[label].collect()
        return kept[label]

    monkeypatch.setattr(similar, "stored", stored)
    similar.join_similar(docs, width=2, percent=50)
    ends = {d for r in kept["similar-candidates rows"] for d in (r.a, r.b)}
    assert {r.doc for r in kept["similar-sets rows"]} == ends
    assert "whole" not in kept["similar-orders"].columns
