import math

import numpy as np

from annoweave.llm import negatives, queries

SCHEMA = "vec_id long, label int, embedding array<double>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def run(spark, rows, every=50, **options):
    vectors = negatives.labelled_vectors(spark.createDataFrame(rows, SCHEMA))
    found = negatives.mine(vectors.where(f"vec_id % {every} = 0"), vectors, **options)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


def brute(rows, every=50, positives=5, count=3):
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, v in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, kind) for j, kind, w in whole
                        if j != i and len(v) == len(w))
        near = [(j, -s) for s, j, kind in scored if kind == label][:positives]
        for j, top in near:
            fits = [(k, -s) for s, k, kind in scored if kind != label and 50 * top <= -100 * s <= 95 * top]
            out += [(i, j, n + 1, k, top, s) for n, (k, s) in enumerate(fits[:count])]
    return sorted(out)


def points(n, size=11, kinds=4):
    return [(i, i % kinds, [math.sin(i * 1.7 + d * d) + (d == i % kinds) for d in range(size)]) for i in range(n)]


def test_equals_brute_force_with_ties(spark):
    rows = points(260) + [(300 + i, i % 3, [0.5] * 11) for i in range(120)]  # one very common vector
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_tables_give_exact_products():
    draw = np.random.default_rng(3)
    for size, wide in ((1, 3), (8, 100), (13, 30_000), (64, 2 ** 20)):
        a = draw.integers(-wide, wide, (7, size))
        b = draw.integers(-wide, wide, (9, size))
        b[0], a[0] = -wide, -wide
        planes = int(wide).bit_length() + 1
        got = negatives.inner_products(negatives.subset_sums(a), negatives.planes_of(b, planes))
        assert (got == b @ a.T).all()


def test_blocks_tiles_and_pieces_do_not_matter(spark, monkeypatch):
    rows = points(150)
    want = brute(rows, every=4, positives=3, count=2)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 500)
    monkeypatch.setattr(negatives, "_TILE", 3)
    monkeypatch.setattr(negatives, "_ROWS", (7, 20))
    assert run(spark, rows, every=4, positives=3, negatives=2) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, None]), (2, 1, [nan, 1.0]), (3, 1, [-inf, 0.0]), (4, 1, None),
            (5, None, [9.0, 9.0]), (None, 1, [9.0, 9.0]), (6, 1, [2.0, 2.0]), (7, 2, [1.5, 1.5]), (8, 2, [1.9, 1.9]),
            (9, 2, [1.0, 1.0, 1.0]), (10, 2, [1.9, 1.9]), (11, -3, [1.0, 1.0]), (12, 2, [0.99, 0.99]), (13, 1, [-1.0, 0.0]),
            (7, 2, [1.5, 1.5]), (50, 3, []), (51, 3, []), (52, 4, [])]
    assert run(spark, rows) == [
        (0, 6, 1, 8, 262144, 248832), (0, 6, 2, 10, 262144, 248832), (0, 6, 3, 7, 262144, 196608),
        # No score lies between shares of nothing but nothing itself.
        (50, 51, 1, 52, 0, 0)]


def test_few_rows_and_none(spark):
    assert run(spark, [(0, 1, [1.0])]) == [] and run(spark, []) == []
    assert run(spark, [(1, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.8])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.8])]) == [(0, 1, 1, 2, 65536, 52224)]


def test_huge_components_are_exact_and_cut_to_a_long(spark):
    rows = [(0, 1, [1e9, 0.0]), (1, 1, [1e5, 7.0]), (2, 2, [9e4, 1e6]), (3, 2, [1e15, 0.0]), (4, 1, [1e15, 1e15]),
            (5, 2, [-1e300, 1.0])]
    top, next_, other = 2 ** 63 - 1, 65536 * 10 ** 14, 65536 * 9 * 10 ** 13
    assert run(spark, rows) == [(0, 1, 1, 2, next_, other), (0, 4, 1, 2, top, other)]


def test_moved_labels_and_query(spark):
    rows = spark.createDataFrame([(i, label) for i, label in ((7, 9), (8, 9), (14, 0))], "vec_id long, label long")
    assert [r["label"] for r in negatives.with_moved_labels(rows).orderBy("vec_id").collect()] == [0, 9, 1]
    assert "op12_hard_negatives" in queries.SQL
