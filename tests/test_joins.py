import pytest
from pyspark.sql import functions as F

from annoweave.operators import joins
from annoweave.session import settle


@pytest.fixture(params=[500_000, 3], ids=["broadcast", "shuffle"])
def limit(request, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", request.param)
    return request.param


def _left(spark):
    """A third of the rows on one key, a third without a key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 40)
    return spark.range(3000).withColumn("key", key.cast("long"))


@pytest.mark.parametrize("hot_exists", [True, False])
def test_semi_and_anti_on_skewed_keys(spark, rows, limit, hot_exists):
    left = _left(spark)
    known = {k for k in range(0, 40, 2)} | ({7} if hot_exists else set())
    right = spark.createDataFrame([(k,) for k in known for _ in range(3)], "id long")
    pairs = [(r.id, r.key) for r in left.collect()]
    kept = sorted(p for p in pairs if p[1] in known)
    assert sorted(rows(joins.keep_matching(left, right, "key"))) == kept
    rest = rows(joins.keep_unmatched(left, right, "key"))
    assert sorted(r[0] for r in rest) == sorted(p[0] for p in pairs if p[1] not in known)


def test_attach_matches_null_keys(spark, rows, limit):
    left = _left(spark)
    lookup = spark.createDataFrame([(None, "none"), (7, "hot"), (2, "two"), (5, "five"), (90, "unused")],
                                   "key long, label string")
    labels = {None: "none", 7: "hot", 2: "two", 5: "five"}
    want = sorted((r.id, labels[r.key]) for r in left.collect() if r.key in labels)
    assert sorted(rows(joins.attach(left, lookup, "key"), "id", "label")) == want


def test_large_sides_are_not_broadcast_by_hint(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.keep_matching(_left(spark), spark.range(50), "key")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in text and "CartesianProduct" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bloom_filter_lets_matches_through_and_few_others(spark):
    keys = spark.range(0, 30_000, 3).withColumnRenamed("id", "_lookup")
    blocks = 4
    bloom = joins.bloom_filter(keys, "_lookup", blocks)
    assert bloom.count() <= blocks and {len(r.words) for r in bloom.collect()} == {512}
    left = spark.range(30_000).unionByName(spark.createDataFrame([(None,)], "id long"))
    passed = {r.id for r in joins.may_match(left, "id", bloom, blocks).collect()}
    assert None not in passed and set(range(0, 30_000, 3)) <= passed
    assert len(passed) - 10_000 < 0.1 * 20_000  # thirteen bits a key


def test_bloom_prefilter_changes_no_row(spark, rows):
    left = spark.range(5_000).selectExpr("if(id % 7 = 0, null, id % 900) k", "cast(id as string) k2", "id _block", "'x' _words")
    right = spark.range(0, 3_000, 2).selectExpr("if(id % 100 = 0, null, id) id", "cast(id as string) name")
    want = rows(joins.keep_matching(left, right, "k", "id"))
    assert rows(joins.keep_matching(left, right, "k", "id", broadcast_rows=0)) == want
    texts = rows(joins.keep_matching(left, right, "k2", "name"))
    assert rows(joins.keep_matching(left, right, "k2", "name", broadcast_rows=0)) == texts
    assert rows(joins.keep_matching(left, right.limit(0), "k", "id", broadcast_rows=-1)) == []


def test_only_matching_rows_are_shuffled(spark):
    left = spark.range(200_000)
    right = settle(spark.range(0, 200_000, 40))
    found = joins.keep_matching(left, right, "id", "id", broadcast_rows=0)
    assert found.count() == 5_000
    # The rows that reach the exact join are those the filter lets through.
    keys = settle(right.withColumnRenamed("id", "_lookup"))
    passed = joins._prefiltered(left, "id", keys, keys.count())
    assert passed.count() < 1.1 * 5_000 + 0.05 * 200_000


def test_filters_too_small_to_help_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOOM_BYTES", joins._BLOCK_BITS // 8)
    left, keys = spark.range(10), settle(spark.range(20_000).withColumnRenamed("id", "_lookup"))
    assert joins._prefiltered(left, "id", keys, 20_000) is left
