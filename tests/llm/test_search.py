import math

from llm import brute

from annoweave.llm import queries, search

SCHEMA = "vec_id long, embedding array<double>, label int"


def run(spark, rows, k=20, every=20):
    vectors = search.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    found = search.top_k(vectors.where(f"vec_id % {every} = 0"), vectors, k)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force_with_ties(spark):
    rows = [(i, [math.sin(i * 1.7 + d) for d in range(8)], 0) for i in range(200)]
    rows += [(200 + i, [0.5] * 8, 0) for i in range(150)]  # one very common vector
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows]
    want = brute.top_k(whole, [(i, v) for i, v in whole if i % 20 == 0], 20)
    assert run(spark, rows) == want


def test_blocks_and_bins_do_not_matter(spark, monkeypatch):
    rows = [(i, [math.cos(i * i + d) * 3 for d in range(4)], 0) for i in range(120)]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows]
    want = brute.top_k(whole, [(i, v) for i, v in whole if i % 4 == 0], 7)
    monkeypatch.setattr(search, "BLOCK_BYTES", 200)
    assert run(spark, rows, 7, 4) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, None], 0), (2, [nan, 1.0], 0), (3, [1.0, -inf], 0), (4, None, 0),
            (None, [9.0, 9.0], 0), (5, [1.0, 1.0], None), (6, [1.0, 1.0, 1.0], 0), (20, [0.0, -0.001], 0),
            (7, [1.0, 1.0], 1), (20, [0.0, -0.001], 0), (40, [], 0)]
    assert run(spark, rows) == [
        (0, 1, 5, 64 * 64 * 3), (0, 2, 7, 64 * 64 * 3), (0, 3, 20, -128), (0, 4, 20, -128),
        (20, 1, 5, -64), (20, 2, 7, -64), (20, 3, 0, -128)]


def test_fewer_candidates_than_asked_and_none(spark):
    assert run(spark, [(0, [1.0], 0), (1, [2.0], 0)]) == [(0, 1, 1, 64 * 128)]
    assert run(spark, [(20, [1.0], 0)]) == []
    assert run(spark, []) == []


def test_huge_components_are_cut_to_a_long(spark):
    rows = [(0, [1e15, 1e15], 0), (1, [1e15, 1e15], 0), (2, [-1e15, 0.0], 0), (3, [1e300, 0.0], 0), (4, [0.0, 1.0], 0)]
    top = 2 ** 63 - 1
    got = run(spark, rows)
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 3), (3, 4), (4, 2)]
    assert got[0][3] == got[1][3] == top and got[3][3] == -top


def test_query_has_sql():
    assert "op7_top_k_search" in queries.SQL
