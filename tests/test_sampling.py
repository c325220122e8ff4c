import hashlib
import random

import pytest
from pyspark.sql import functions as F

from annoweave.operators import joins, sampling
from annoweave.operators.sampling import Targets


def _hash(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def by_hand(pairs, size, seed=42):
    """The documented procedure as a loop: quotas in order of appearance, then a top-up."""
    if len(pairs) <= size:
        return sorted(p[0] for p in pairs)
    groups = {}
    for i, s in pairs:
        groups.setdefault(s, []).append(i)
    chosen, left = [], size
    for members in groups.values():
        if left <= 0:
            break
        take = min(max(1, len(members) * size // len(pairs)), left)
        chosen += sorted(members, key=lambda i: (_hash(seed, i), i))[:take]
        left -= take
    picked = set(chosen)
    rest = sorted((i for i, _ in pairs if i not in picked), key=lambda i: (_hash(seed + 1, i), i))
    return sorted(chosen + rest[:left])


def _pairs(count, strata, hot_share, seed):
    rng = random.Random(seed)
    names = [None, *range(strata - 1)]
    return [(i, names[0] if rng.random() < hot_share else rng.choice(names)) for i in range(count)]


def _sample(spark, pairs, size, parts=3, seed=42):
    df = spark.createDataFrame(pairs, "id long, s long").repartition(parts)
    out = sampling.stratified_sample(df, size, stratum="s", seed=seed)
    return sorted(r.id for r in out.collect())


@pytest.fixture(params=["rows", "steps", "tables"])
def summaries(request, monkeypatch):
    """Summaries as plain rows at once, after counts by digit, or as tables."""
    size = {"rows": sampling.LOCAL_ROWS, "steps": 130, "tables": 0}[request.param]
    monkeypatch.setattr(sampling, "LOCAL_ROWS", size)


@pytest.mark.parametrize("count,strata,hot,size", [
    (400, 4, 0.4, 1), (400, 4, 0.4, 37), (400, 4, 0.4, 399), (400, 4, 0.4, 400),
    (300, 60, 0.0, 20), (300, 60, 0.35, 150), (50, 50, 0.0, 7)])
def test_same_rows_as_the_loop(spark, summaries, count, strata, hot, size):
    pairs = _pairs(count, strata, hot, size)
    assert _sample(spark, pairs, size) == by_hand(pairs, size)


@pytest.mark.parametrize("size", [1, 60, 250])
def test_ranking_few_rows_at_a_time_changes_nothing(spark, monkeypatch, size):
    pairs = _pairs(300, 6, 0.3, 5)
    monkeypatch.setattr(sampling, "_FEW", 1)
    monkeypatch.setattr(sampling, "LOCAL_ROWS", 0)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert _sample(spark, pairs, size) == by_hand(pairs, size)
    df = spark.createDataFrame(pairs, "id long, s long")
    want = sorted(sorted((i for i, _ in pairs), key=lambda i: _hash(42, i))[:size])
    assert sorted(r.id for r in sampling.uniform_sample(df, size).collect()) == want


@pytest.mark.parametrize("few,local", [(1000, 0), (1, 0), (1000, 150), (1000, 100_000)])
@pytest.mark.parametrize("size", [100, 301, 2999])
def test_repeated_ids_and_equal_rows(spark, monkeypatch, few, local, size):
    monkeypatch.setattr(sampling, "_FEW", few)
    monkeypatch.setattr(sampling, "LOCAL_ROWS", local)
    df = spark.range(3000).selectExpr("id % 1000 id", "id % 7 s", "id div 1500 half")
    for out in (sampling.uniform_sample(df, size), sampling.stratified_sample(df, size, stratum="s")):
        assert out.count() == size and out.exceptAll(df).count() == 0
    same = spark.range(500).selectExpr("cast(1 as long) id", "cast(null as long) s")
    assert sampling.uniform_sample(same, 77).count() == 77
    assert sampling.stratified_sample(same, 77, stratum="s").count() == 77


def test_text_strata_and_clashing_names(spark, summaries):
    rows = [(i, None if i % 9 == 0 else "äbz"[i % 3], i % 4, -i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s string, size long, take long")
    out = sampling.stratified_sample(df, 50, stratum="s")
    assert out.columns == df.columns
    assert sorted(r.id for r in out.collect()) == by_hand([r[:2] for r in rows], 50)
    report = sampling.stratum_quotas(df, 50, stratum="s", order="id")
    assert sorted(r["size"] for r in report.collect()) == [45, 89, 133, 133]


def test_strata_of_numbers_with_fractions(spark):
    df = spark.range(400).selectExpr("id", "if(id % 5 = 0, double('nan'), id % 3 / 2) s")
    out = sampling.stratified_sample(df, 60, stratum="s")
    assert out.count() == 60


def _jobs(spark, work):
    context = spark.sparkContext
    context.setJobGroup("counted", "")
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup("counted"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_a_sample_takes_few_jobs(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "id % 5 s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    uniform = _jobs(spark, lambda: sampling.uniform_sample(df, 300).collect())
    stratified = _jobs(spark, lambda: sampling.stratified_sample(df, 301, stratum="s").collect())
    assert 2 < uniform <= 8 and 2 < stratified <= 18, (uniform, stratified)


def test_rows_without_id_are_refused(spark, summaries):
    df = spark.createDataFrame([(1, 1), (None, 1)], "id long, s long")
    with pytest.raises(ValueError):
        sampling.uniform_sample(df, 1)
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, 1, stratum="s")


def test_running_total(spark):
    df = spark.range(500).selectExpr("id * 7 % 500 a", "id % 11 n").repartition(5)
    found = {r.a: r._before for r in sampling.running_total(df, ["a"], "n").collect()}
    ahead, want = 0, {}
    for a, n in sorted((r.a, r.n) for r in df.collect()):
        want[a], ahead = ahead, ahead + n
    assert found == want


def test_partitioning_does_not_matter_but_the_seed_does(spark):
    pairs = _pairs(500, 5, 0.2, 3)
    assert _sample(spark, pairs, 80, 1) == _sample(spark, pairs, 80, 13)
    assert _sample(spark, pairs, 80, seed=1) != _sample(spark, pairs, 80, seed=2)
    assert _sample(spark, pairs, 80, seed=7) == by_hand(pairs, 80, 7)


def test_uniform_sample(spark):
    df = spark.range(5000)
    for size in (0, 1, 100, 4999, 5000, 9000):
        got = sorted(r.id for r in sampling.uniform_sample(df, size).collect())
        assert got == sorted(sorted(range(5000), key=lambda i: _hash(42, i))[:size])


def test_equal_strata_get_equal_shares(spark):
    df = spark.range(12_000).withColumn("license", F.col("id") % 2 + 1)
    out = sampling.stratified_sample(df, 1000, stratum="license")
    assert sorted(tuple(r) for r in out.groupBy("license").count().collect()) == [(1, 500), (2, 500)]


def test_quota_report_lists_every_stratum(spark):
    pairs = _pairs(300, 40, 0.5, 9)
    df = spark.createDataFrame(pairs, "id long, s long")
    quotas = {r.s: (r["size"], r.take) for r in
              sampling.stratum_quotas(df, 10, stratum="s", order="id").collect()}
    assert len(quotas) == len({s for _, s in pairs})
    assert sum(t for _, t in quotas.values()) <= 10 and any(t == 0 for _, t in quotas.values())


def test_gate_report_is_strict(spark):
    at, over = spark.range(10_000), spark.range(10_001)
    assert not sampling.gate_report(at, at).first().large
    assert sampling.gate_report(over, at).first().large
    report = sampling.gate_report(at, over).first()
    assert (report.images, report.annotations, report.large) == (10_000, 10_001, True)


def test_targets():
    assert Targets.of(500) == Targets(500, 500)
    assert Targets.of(500, small=True) == Targets.of(small=True) == Targets(100, 200)
    for size in (None, 0, -1):
        with pytest.raises(ValueError):
            Targets.of(size)


@pytest.mark.parametrize("method", ["stratified", "uniform"])
def test_children_belong_to_sampled_parents(spark, method):
    images = spark.range(12_000).withColumn("license", F.col("id") % 3)
    anns = spark.range(15_000).select("id", (F.col("id") % 12_000).alias("image_id"),
                                      (F.col("id") % 2).alias("category_id"))
    kept, children = sampling.referential_sample(images, anns, Targets.of(1000), method=method)
    parents = {r.id for r in kept.collect()}
    found = children.collect()
    expected = sum(1 for i in range(15_000) if i % 12_000 in parents)
    assert len(parents) == 1000 and len(found) == min(1000, expected)
    assert len({r.id for r in found}) == len(found)
    assert all(r.image_id in parents for r in found)


def test_child_sampling_matches_the_loop(spark):
    parents = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "id long")
    rows = [(i, 0 if i % 3 == 0 else i % 60, i % 5) for i in range(900)]
    children = spark.createDataFrame(rows, "id long, image_id long, category_id long")
    related = [(i, c) for i, p, c in rows if p % 2 == 0]
    out = sampling.sample_children(children, parents, 100, parent_key="image_id", stratum="category_id")
    assert sorted(r.id for r in out.collect()) == by_hand(related, 100)


def test_all_images_can_be_kept(spark):
    images = spark.range(500).withColumn("license", F.lit(1))
    anns = spark.range(3000).select("id", (F.col("id") % 500).alias("image_id"),
                                    (F.col("id") % 4).alias("category_id"))
    kept, children = sampling.referential_sample(images, anns, Targets.of(200), all_images=True)
    assert kept.count() == 500 and children.count() == 200
    with pytest.raises(ValueError):
        sampling.referential_sample(images, anns, Targets.of(200), method="other")


def test_unsampled_is_the_complement(spark):
    df = spark.range(300)
    sample = sampling.uniform_sample(df, 40)
    rest = sampling.unsampled(df, sample, at_most=40)
    assert rest.count() == 260 and rest.intersect(sample).count() == 0

