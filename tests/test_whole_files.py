"""Files that are one JSON value: every byte is fetched about once, and the rows are those of a multi-line read."""

import json

import pytest

from annoweave.schemas import element_schema
from annoweave.sources.documents import read_documents
from annoweave.sources.taxonomy import read_categories, unreadable_categories
from conftest import dataset, image, taxon


def bytes_read(spark):
    every = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in every if s.getScheme() == "file")


def test_numbers_are_not_fetched_one_by_one(spark, tmp_path):
    array, whole = tmp_path / "c.json", tmp_path / "d.json"
    array.write_text(json.dumps([taxon(i, f"tug {i}") for i in range(3000)]))
    whole.write_text(json.dumps(dataset([image(i) for i in range(3000)], [])))
    for path, rows in ((array, read_categories(spark, str(array))), (whole, read_documents(spark, str(whole))["images"])):
        before = bytes_read(spark)
        assert rows.selectExpr("sum(id)").first()[0] == 3000 * 2999 // 2
        assert bytes_read(spark) - before < 3 * path.stat().st_size


TEXTS = {
    "array": json.dumps([taxon(1, "tug"), taxon(2, "buoy é\n")], indent=1),
    "object": "\n" + json.dumps(taxon(3, "ferry")) + "\n\n",
    "numbers": '[{"id": 9007199254740993, "level": 1.50}, {"id": "7", "name": 1e2, "supercategory": {"a": [1, 2.0]}}]',
    "null": "null", "empty": "", "blank": " \n ", "bad": '[{"id": 1}, {"id" 2}]', "cut": '[{"id": 1}', "mixed": '[{"id": 1}, 5, null]',
    "after": '[{"id": 1}] [{"id": 2}]', "word": "tug", "text": '"tug"'}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
def test_same_rows_as_a_multi_line_read(spark, tmp_path, rows, name, mark):
    if mark and name == "empty":
        pytest.skip("a mark alone is an empty file here, and damaged there")
    path = tmp_path / "c.json"
    path.write_bytes(mark + TEXTS[name].encode())
    schema = element_schema("categories").add("_corrupt_record", "string")
    found = spark.read.schema(schema).option("multiLine", True).json(str(path))
    good = found.where("_corrupt_record is null").selectExpr(
        "cast(id as bigint) id", "name", "supercategory", "cast(cast(level as double) as int) level", "taxonomy_id")
    if name != "numbers":
        assert rows(read_categories(spark, str(path))) == rows(good)
        assert unreadable_categories(spark, str(path)).count() == found.where(
            "coalesce(_corrupt_record, id) = _corrupt_record").count()
    else:
        assert rows(read_categories(spark, str(path)), "id", "name", "supercategory") == rows(
            good.where("level is null"), "id", "name", "supercategory")
