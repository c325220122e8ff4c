"""Keys checked at load time, and loads that appear whole or not at all."""

import json

import pytest

from annoweave.operators import constraints
from annoweave.plans.load import CHECKED, load_documents, read_rejects
from annoweave.session import settle
from annoweave.sinks import versions
from annoweave.sinks.tables import write_tables
from annoweave.sources.manifests import folders, manifest
from annoweave.sources.tables import read_table, read_tables
from conftest import annotation, dataset, image

STRICT = type(CHECKED)(**{**vars(CHECKED), "fail_on_rejects": True})


def keyed(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, url string")


def ids(df, column="id"):
    return sorted((r[column] for r in df.collect()), key=repr)


def test_split_repeats(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3), (None, "d", 4), (None, "d", 4), (1, "a", 1)],
                                 "id long, name string, place int")
    first, later = constraints.split_repeats(rows, ["id"], "place")
    assert sorted(map(tuple, first.collect()), key=repr) == sorted(
        [(1, "a", 1), (2, "c", 3), (None, "d", 4), (None, "d", 4)], key=repr)
    assert sorted(map(tuple, later.collect())) == [(1, "a", 1), (1, "b", 2)]
    nothing, none = constraints.split_repeats(rows.limit(0), ["id", "name"])
    assert nothing.count() == none.count() == 0 and nothing.columns == rows.columns


def test_one_hot_key(spark):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 7, id) id", "cast(id as string) name")
    first, later = constraints.split_repeats(rows, ["id"], "name")
    assert first.count() == 40_001 - (1 if 7 % 3 else 0) and later.count() == 20_000 - 1 + (1 if 7 % 3 else 0)


def test_appends_read_the_buckets_of_their_own_ids(spark, tmp_path):
    many = spark.range(0, 40 * constraints.BUCKET_IDS, 997)
    constraints.write_keys(many, ["id"], str(tmp_path / "k"))
    batch = spark.createDataFrame([(997,), (998,), (-5,), (None,)], "id long")
    new, known = constraints.split_known(batch, ["id"], [str(tmp_path / "k")])
    assert ids(new) == [-5, 998, None] and ids(known) == [997]
    found = constraints.stored_keys(spark, [str(tmp_path / "k")], ["id"], [0])
    plan_text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan_text and "_bucket" in plan_text.split("PartitionFilters: [")[1].split("]")[0]
    assert found.count() == -(-constraints.BUCKET_IDS // 997)
    assert constraints.split_known(batch, ["id"], [])[0].count() == 4


def test_publish_append_and_replace(spark, tmp_path):
    root = str(tmp_path / "d")
    refused = versions.publish(spark, {"licenses": keyed(spark, [(1, "a", "x"), (1, "b", "x"), (2, "c", "x")])}, root, "one")
    assert [(r.table, r.key, r.reason) for r in refused.collect()] == [("licenses", "1", "repeated")]
    refused = versions.publish(spark, {"licenses": keyed(spark, [(2, "z", "x"), (3, "d", "x")])}, root, "two", append=True)
    assert [(r.key, r.reason, json.loads(r.row)["name"]) for r in refused.collect()] == [("2", "loaded before", "z")]
    assert ids(read_table(spark, root, "licenses")) == [1, 2, 3]
    assert manifest(spark, root)["loads"] == ["one", "two"]
    again = versions.publish(spark, {"licenses": keyed(spark, [(9, "q", "x")])}, root, "two", append=True)
    assert again.count() == 0 and ids(read_table(spark, root, "licenses")) == [1, 2, 3]
    assert read_table(spark, root, "images").count() == 0
    with pytest.raises(ValueError, match="duplicate keys"):
        versions.publish(spark, {"licenses": keyed(spark, [(3, "d", "x")])}, root, "three", append=True, fail_on_duplicates=True)
    with pytest.raises(ValueError, match="stored as parquet"):
        versions.publish(spark, {"licenses": keyed(spark, [])}, root, "three", append=True, fmt="orc")
    versions.publish(spark, {"licenses": keyed(spark, [(3, "d", "x")])}, root, "new/one")
    assert ids(read_table(spark, root, "licenses")) == [3] and manifest(spark, root)["loads"] == ["new/one"]
    assert len(versions.remove_unpublished(spark, root)) == 2
    assert ids(read_table(spark, root, "licenses")) == [3] and versions.remove_unpublished(spark, root) == []


def test_a_load_that_stops_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "d")
    versions.publish(spark, {"licenses": keyed(spark, [(1, "a", "x")])}, root, "one")
    monkeypatch.setattr(versions, "write_keys", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        versions.publish(spark, {"licenses": keyed(spark, [(2, "b", "x")])}, root, "two", append=True)
    assert ids(read_table(spark, root, "licenses")) == [1] and manifest(spark, root)["number"] == 1
    monkeypatch.undo()
    versions.publish(spark, {"licenses": keyed(spark, [(2, "b", "x")])}, root, "two", append=True)
    assert ids(read_table(spark, root, "licenses")) == [1, 2]


def test_two_publishers_at_once(spark, tmp_path):
    root = str(tmp_path / "d")
    content = {"format": "parquet", "loads": ["a"], "tables": {}, "keys": {}}
    versions._publish(spark, root, 1, content)
    with pytest.raises(RuntimeError, match="meanwhile"):
        versions._publish(spark, root, 1, {**content, "loads": ["b"]})
    assert manifest(spark, root)["loads"] == ["a"]


def test_plain_folders_have_no_manifest(spark, tmp_path):
    write_tables({"licenses": keyed(spark, [(1, "a", "x")])}, str(tmp_path))
    assert folders(spark, str(tmp_path), "licenses") is None and ids(read_table(spark, str(tmp_path), "licenses")) == [1]


def test_loads_refuse_repeated_keys(spark, document, tmp_path):
    twice = {**annotation(2, 1), "attribute_ids": [1, 2, 1]}
    content = dataset([image(1), image(2), {**image(1), "width": 5}], [annotation(1, 1), twice, annotation(1, 2)])
    tables = load_documents(spark, document(content), str(tmp_path / "a"))
    assert ids(tables["images"]) == [1, 2] and ids(tables["annotations"]) == [1, 2]
    assert {r.width for r in tables["images"].collect()} == {1024}
    assert tables["annotation_attributes"].count() == 3 and tables["segmentations"].count() == 6
    rows = read_rejects(spark, str(tmp_path / "a"), "duplicates").collect()
    assert sorted((r.table, r.key) for r in rows) == [("annotation_attributes", "2,1"), ("annotations", "1"), ("images", "1")]
    with pytest.raises(ValueError, match="duplicate input"):
        load_documents(spark, document(content), str(tmp_path / "b"), STRICT)


def test_published_load_and_append(spark, document, tmp_path):
    root = str(tmp_path / "d")
    load_documents(spark, document(dataset([image(1)], [annotation(1, 1)])), root, load_id="a")
    more = document(dataset([image(1), image(2)], [annotation(1, 1), annotation(2, 2)]), "more.json")
    tables = load_documents(spark, more, root, load_id="b", append=True)
    assert ids(tables["images"]) == [1, 2] and ids(tables["annotations"]) == [1, 2]
    assert read_tables(spark, root)["segmentations"].count() == 6
    reasons = {(r.table, r.reason) for r in read_rejects(spark, root, "duplicates").collect()}
    assert ("images", "loaded before") in reasons and ("segmentations", "loaded before") in reasons
    with pytest.raises(ValueError, match="needs an id"):
        load_documents(spark, more, root, append=True)


@pytest.mark.parametrize("hot", [0, 3000])
def test_no_task_groups_or_sorts_many_keys(spark, tmp_path, monkeypatch, hot):
    """Keys are dealt to more tasks as there are more of them, a key of many rows first to several."""
    monkeypatch.setattr(constraints, "TASK_ROWS", 500)
    links = spark.range(0, 4000, 1, 4).selectExpr("id annotation_id", "id % 7 attribute_id")
    if hot:
        links = links.unionByName(spark.range(0, hot, 1, 4).selectExpr("5L annotation_id", "5L attribute_id"))
    key = ("annotation_id", "attribute_id")
    dealt = constraints._repeated(settle(links), key).selectExpr("spark_partition_id() p")
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    assert constraints.with_repeats({"t": links}, {"t": key}) == (["t"] if hot else [])
    kept, extra = constraints.split_repeats(links, key)
    assert kept.count() == 4000 and extra.count() == hot
    constraints.write_keys(links, key, str(tmp_path / "keys"))
    assert spark.read.parquet(str(tmp_path / "keys")).count() == 4000 + hot
