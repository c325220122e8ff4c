from itertools import product

import pytest
from pyspark.sql import functions as F

from annoweave.llm import mixing


def test_targets_share_the_excess():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 500})
    # a and the null source stop at twice their size; b and c share the rest two to one.
    assert got == {"a": 20.0, None: 1000.0, "b": pytest.approx(1830.0), "c": pytest.approx(915.0)}
    assert sum(mixing.targets({"a": 0, "b": 0}).values()) == 0
    assert mixing.targets({}) == {}


def best_flow(patterns, quotas, most):
    """Most words and least cost over all whole choices, by trying them."""
    arcs = [(p, s, copy) for p in patterns for s in p for copy in range(most)]
    best = (0, 0)
    for amounts in product(*[range(patterns[p] + 1) for p, _, _ in arcs]):
        into, out = {}, {}
        for (p, s, copy), x in zip(arcs, amounts):
            into[s] = into.get(s, 0) + x
            out[p, copy] = out.get((p, copy), 0) + x
        if all(into[s] <= quotas[s] for s in into) and all(x <= patterns[p] for (p, _), x in out.items()):
            best = max(best, (sum(amounts), -sum(x * copy for (_, _, copy), x in zip(arcs, amounts))))
    return best


@pytest.mark.parametrize("patterns, quotas", [
    ({("a",): 2, ("a", "b"): 2}, {"a": 3, "b": 3}),
    ({("a",): 1, ("b",): 3}, {"a": 3, "b": 2}),
    ({("a", "b"): 2, ("b",): 2}, {"a": 0, "b": 3}),
])
def test_flow_is_largest_and_cheapest(patterns, quotas):
    given = mixing.route(patterns, quotas, 2)
    words = sum(given.values())
    cost = sum(max(0, x - patterns[p]) for p, x in given.items())
    assert (words, -cost) == best_flow(patterns, quotas, 2)


def test_sources_come_near_their_targets(docs):
    mixed = mixing.mix(docs).collect()
    taken, wanted = {}, {}
    for r in mixed:
        source = r["sources"][0]
        taken[source[0]] = taken.get(source[0], 0) + r["size"] * r["copies"]
        wanted[source[0]] = source[2]
        assert 0 <= r["copies"] <= 2
    largest = max(r["size"] for r in mixed if r["size"] < 5000)
    assert all(abs(taken[s] - wanted[s]) <= largest for s in wanted if s != "src3")
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed))


def test_order_and_partitions_do_not_matter(docs):
    def rows(df):
        return sorted((repr(r["doc_id"]), r["size"], r["copies"]) for r in mixing.mix(df).collect())
    assert rows(docs) == rows(docs.orderBy(F.desc("doc_id")).repartition(7))


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["x"] if i < 10 else ["x", "y"] if i < 20 else []) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, member array<string>")
    mixed = mixing.mix(df, "member", share=1.0).collect()
    assert {tuple(r["pattern"]) for r in mixed} == {("x",), ("y", "x"), (None,)}
    assert sum(r["copies"] * r["size"] for r in mixed) > 0


def test_mixed_rows_repeat_whole_rows(cluttered):
    mixed = mixing.mixed_rows(cluttered)
    assert mixed.columns == cluttered.columns
    want = sorted(repr(r["doc_id"]) for r in mixing.mix(cluttered).collect() for _ in range(r["copies"]))
    assert sorted(repr(r["doc_id"]) for r in mixed.collect()) == want


def test_empty_table(nothing):
    assert mixing.mix(nothing).collect() == []
    assert mixing.mixed_rows(nothing).collect() == []
