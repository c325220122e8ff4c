import hashlib
import json
from collections import Counter
from functools import cache

import pytest
from tokenizers import Tokenizer

from annoweave.llm import alignment, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    return alignment.read_encoders(queries.BYTE_LEVEL_PATH, queries.MODEL_PATH)


@cache
def tokenizer():
    found = Tokenizer.from_file(queries.BYTE_LEVEL_PATH)
    found.encode_special_tokens = True
    return found


def plain_groups(text, encoders):
    """The groups of a text by walking both token lists byte by byte; none where bytes differ."""
    _, b, spelled_a, spelled_b, *_ = encoders.ready()
    if not text:
        return []
    ids = [tokenizer().encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    parts = [[spelled_a[i] for i in ids[0]], [spelled_b[i] for i in ids[1]]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return []
    out, sizes, at = [([], [])], [0, 0], [0, 0]
    while at[0] < len(ids[0]) or at[1] < len(ids[1]):
        side = 0 if at[0] < len(ids[0]) and (sizes[0] <= sizes[1] or at[1] == len(ids[1])) else 1
        out[-1][side].append(ids[side][at[side]])
        sizes[side] += len(parts[side][at[side]])
        at[side] += 1
        if sizes[0] == sizes[1]:
            out.append(([], []))
    return out[:-1]


def brute(rows, encoders):
    found = [(i, plain_groups(text, encoders)) for i, text in rows]
    held = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for _, groups in found]
    count = Counter(pair for links in held for pair in links)
    best: dict = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, groups), links in zip(found, held):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((i, sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups),
                    sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def run(docs, encoders):
    found = alignment.align(docs, encoders)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


ODD = [(1, "a▁b"), (2, "<|endoftext|> and <s> </s>"), (3, "tab\tand\r\nline\n\n  two   spaces"),
       (4, "日本語のテキスト 😀😀 über naïve é"), (5, "\x00 zero"), (6, " "), (7, "   "), (8, "x"),
       (9, "0123456789" * 40), (10, "ab" * 3000), (11, "\n" * 50), (12, "ﬁn   ​ ﻿")]


def test_equals_brute_force(spark, docs, encoders):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + ODD
    both = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(both, encoders) == sorted(brute(rows, encoders), key=repr)


def test_spills_merges_and_salts_do_not_matter(spark, docs, encoders, monkeypatch):
    want = run(docs, encoders)
    monkeypatch.setattr(alignment, "RUN_RECORDS", 50)
    monkeypatch.setattr(alignment, "TEXT_BYTES", 300)
    monkeypatch.setattr(alignment, "TASK_RECORDS", 200)
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    monkeypatch.setattr(alignment, "_LARGE", 4)
    monkeypatch.setattr(alignment, "_SLICE", 5)
    assert run(docs.repartition(3), encoders) == want


def test_given_texts(spark, encoders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert run(docs, encoders) == sorted(brute(rows, encoders), key=repr)


def test_texts_without_tokens(spark, encoders):
    rows = [(1, None), (2, ""), (3, "▁"), (None, None)]
    found = run(spark.createDataFrame(rows, "doc_id long, text string"), encoders)
    assert found == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3, None)], key=repr)


def test_empty_table_and_extra_columns(spark, nothing, cluttered, encoders):
    assert run(nothing, encoders) == []
    more = ["doc_id", "n", "row", "key", "part", "n_best"]
    found = alignment.align(cluttered.withColumn("n_best", cluttered["n"]), encoders, more)
    assert found.columns == more[:-1] + COLUMNS[1:]
    assert {r["n"] for r in found.collect()} == {7}


def test_runs_and_heap():
    import numpy as np
    columns = [np.array([], dtype=np.int64), np.array([0, 255, 256, 2 ** 40]), np.array([3])]
    for got, want in zip(alignment.expanded(alignment.squeezed(*columns)), columns):
        assert got.tolist() == want.tolist()
    runs = [(np.array([1, 5, 9]), np.array([1, 2, 3])), (np.array([5, 9]), np.array([10, 20])),
            (np.array([0]), np.array([7]))]
    assert list(alignment.merged(runs)) == [(0, 7), (1, 1), (5, 12), (9, 23)]
    assert list(alignment.merged([])) == []


def test_ranks_only_where_they_describe_the_vocabulary(encoders):
    whole = json.loads(encoders.byte_level)
    spelled = encoders.ready()[2]
    assert alignment._ranked(whole, spelled) is not None
    model = {**whole["model"], "merges": whole["model"]["merges"][::-1]}
    assert alignment._ranked({**whole, "model": model}, spelled) is None
    assert alignment._ranked({**whole, "normalizer": {"type": "NFC"}}, spelled) is None


def test_both_libraries_and_very_long_white_space(encoders):
    texts = [" a" + " " * 20_000 + "b\n", " été 12 \u2003x's <|endoftext|>", " x" * 50]
    encode_a = encoders.ready()[0]
    want = [tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
    assert encode_a(texts) == want and encode_a(texts[1:]) == want[1:]
