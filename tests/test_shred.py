import json

import pytest
from pyspark.sql.utils import AnalysisException

from annoweave.operators import shred
from annoweave.sources.documents import (
    documents_from_text, read_documents, read_member_files, read_member_lines)
from conftest import annotation, dataset, image

GEOMETRY = [
    {"id": 1, "segmentation": [[1, 2, 3.5, 4, 9]]},
    {"id": 2, "segmentation": [[1, "2", "x", 4, True, 5]]},
    {"id": 3, "segmentation": {"counts": [1, 2], "size": [3, 4]}},
    {"id": 4},
    {"id": 5, "segmentation": [[7]]},
    {"id": 6, "segmentation": [[], [1, None, 2, 3], "text", 7, [[1, 2]]]},
    {"id": 7, "segmentation": None},
]


def test_malformed_geometry(spark, rows, document):
    raw = read_documents(spark, document({"annotations": GEOMETRY}))["annotations"]
    strict = [(1, 0, 0, 1.0, 2.0), (1, 0, 1, 3.5, 4.0), (2, 0, 2, 1.0, 5.0), (6, 1, 1, 2.0, 3.0)]
    assert rows(shred.polygon_points(raw)) == sorted(strict, key=repr)
    assert rows(shred.polygon_points(raw, strict=False)) == sorted(
        strict + [(2, 0, 0, 1.0, 2.0)], key=repr)
    assert rows(shred.rejected_points(raw)) == [
        (2, 0, 0, "1", "2"), (2, 0, 1, "x", "4"), (6, 1, 0, "1", None)]
    pairs = shred.coordinate_pairs(raw).count()
    for mode in (True, False):
        kept = shred.polygon_points(raw, mode).count()
        assert kept + shred.rejected_points(raw, mode).count() == pairs


def test_boxes(spark, rows, document):
    boxes = [{"id": 1, "bbox": [1, 2, 3.5, 4]}, {"id": 2}, {"id": 3, "bbox": [1, 2]},
             {"id": 4, "bbox": None}, {"id": 5, "bbox": "box"}, {"id": 6, "bbox": [1, 2, "x", 4]},
             {"id": 7, "bbox": [1, None, "3", 4]}]
    raw = read_documents(spark, document({"annotations": boxes}))["annotations"]
    assert rows(shred.annotations_table(raw), "id", "bbox_x", "bbox_width") == [
        (1, 1.0, 3.5), (2, 0.0, 0.0), (7, 1.0, 3.0)]
    assert [r[0] for r in rows(shred.rejected_boxes(raw))] == [3, 4, 5, 6]


def test_attribute_lists(spark, rows, document):
    found = [{"id": 1, "attribute_ids": [1, "2", 3]}, {"id": 2}, {"id": 3, "attribute_ids": None},
             {"id": 4, "attribute_ids": []}, {"id": 5, "attribute_ids": [9]}]
    raw = read_documents(spark, document({"annotations": found,
                                          "attributes": [{"id": 1}, {"id": 2}, {"id": 3}]}))
    links = shred.annotation_links(raw["annotations"])
    assert rows(links) == [(1, 1), (1, 3), (5, 9)]
    assert rows(shred.known_links(links, raw["attributes"])) == [(1, 1), (1, 3)]
    assert (1, 2) in rows(shred.annotation_links(raw["annotations"], numbers_only=False))


def test_placeholder_license(spark, rows, document):
    raw = read_documents(spark, document({
        "licenses": [{"id": 0}, {"id": "0"}, {"id": 3, "name": "x"}, {"name": "no id"}],
        "images": [image(1, 0), image(2, "0"), image(3, 3), {"id": 4}]}))
    assert rows(shred.licenses_table(raw["licenses"]), "id") == [(3,), (None,)]
    assert shred.licenses_table(raw["licenses"], drop_zero=False).count() == 4
    assert rows(shred.images_table(raw["images"]), "id", "license") == [
        (1, None), (2, None), (3, 3), (4, None)]
    assert shred.zero_license_count(raw["images"]).first()[0] == 2


def test_flags(spark, rows, document):
    found = [{"id": i, "iscrowd": v} for i, v in enumerate([0, 1, True, False, None, "maybe"])]
    raw = read_documents(spark, document({"annotations": found}))["annotations"]
    assert rows(shred.annotations_table(raw), "id", "iscrowd") == [
        (0, False), (1, True), (2, True), (3, False), (4, None), (5, None)]


def test_references_are_enforced(spark, rows, document):
    content = dataset([image(1), image(2)],
                      [annotation(1, 1), annotation(2, 9), annotation(3, 2, 9), annotation(4, 2, 2)])
    raw = read_documents(spark, document(content))
    kept = shred.kept_annotations(raw["annotations"], raw["images"], raw["categories"])
    assert rows(kept, "id") == [(1,), (4,)]


def test_missing_members_and_missing_file(spark, document):
    raw = read_documents(spark, document({"images": [image(1)]}))
    assert {n: df.count() for n, df in raw.items()} == {
        "info": 0, "licenses": 0, "categories": 0, "attributes": 0, "images": 1, "annotations": 0}
    with pytest.raises(AnalysisException):
        read_documents(spark, "/tmp/no-such-document.json")


def test_input_order_spans_files(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"p{part}.json").write_text(json.dumps(
            {"images": [image(part * 10 + i) for i in (2, 0, 1)]}))
    raw = read_documents(spark, str(tmp_path))["images"]
    assert [r.id for r in raw.orderBy("_order").collect()] == [2, 0, 1, 12, 10, 11, 22, 20, 21]


def test_lines_and_text_match_documents(spark, rows, document, tmp_path):
    found = [annotation(i, 1) for i in range(5)]
    lines = tmp_path / "annotations.jsonl"
    lines.write_text("\n\n".join(json.dumps(a) for a in found) + "\n")
    whole = read_documents(spark, document({"annotations": found}))["annotations"]
    by_line = read_member_lines(spark, "annotations", str(lines))["annotations"]
    text = spark.createDataFrame([("d", json.dumps({"annotations": found}))], "doc string, text string")
    from_text = documents_from_text(text, "text", "doc")["annotations"]
    expected = rows(shred.annotations_table(whole))
    assert len(expected) == 5
    assert rows(shred.annotations_table(by_line)) == expected
    assert rows(shred.annotations_table(from_text)) == expected
    assert rows(shred.polygon_points(by_line)) == rows(shred.polygon_points(from_text))
    assert [r.id for r in by_line.orderBy("_order").collect()] == [0, 1, 2, 3, 4]


def test_damaged_document_is_reported(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"images": [image(1)]}))
    (tmp_path / "bad.json").write_text('{"images": [')
    raw = read_documents(spark, str(tmp_path))
    assert [r.source.rsplit("/")[-1] for r in raw.damaged.collect()] == ["bad.json"]
    assert raw["images"].count() == 1
    text = spark.createDataFrame([("a", '{"images": ['), ("b", json.dumps({"images": [image(1)]}))], "doc string, text string")
    raw = documents_from_text(text, "text", "doc")
    assert [r.source for r in raw.damaged.collect()] == ["a"] and raw["images"].count() == 1


def test_values_of_other_types_are_converted_or_reported(spark, rows, document):
    found = [{"id": 1, "width": 800.5, "height": 2}, {"id": "3", "width": "640", "height": 480.0, "license": "0"},
             {"id": 4, "width": None}, {"id": "x"}, {"id": 5, "license": True}, {"id": 1e3, "height": 3_000_000_000},
             {"id": 9_007_199_254_740_993}]
    anns = [{"id": 1, "image_id": "2", "area": "12.5", "category_id": 3}, {"id": 2, "area": "wide"}]
    levels = [{"id": 1, "level": "2"}, {"id": 2, "level": 1.5}]
    raw = read_documents(spark, document({"images": found, "annotations": anns, "categories": levels}))
    assert rows(raw["images"], "id", "width", "height", "license") == [
        (3, 640, 480, 0), (4, None, None, None), (9_007_199_254_740_993, None, None, None)]
    assert rows(raw["annotations"], "id", "image_id", "area") == [(1, 2, 12.5)]
    assert rows(raw["categories"], "id", "level") == [(1, 2)]
    assert sorted((r.member, r.fields) for r in raw.unconverted.collect()) == [
        ("annotations", "area"), ("categories", "level"), ("images", "height"), ("images", "id"),
        ("images", "license"), ("images", "width")]


def test_damaged_lines_are_reported(spark, tmp_path):
    (tmp_path / "images.jsonl").write_text('{"id": 1}\n{"id": 2,\n\n[1, 2\n{"id": 3}\n')
    raw = read_member_files(spark, str(tmp_path))
    assert sorted(r.id for r in raw["images"].collect()) == [1, 3]
    assert sorted(r.text for r in raw.damaged.collect()) == ["[1, 2", '{"id": 2,']


def test_orphans_are_reported(spark, rows, document):
    content = dataset([image(1)], [annotation(1, 1), annotation(2, 9), annotation(3, 1, 9),
                                   {**annotation(4, 1), "image_id": None}, annotation(5, 1, 1, [1, 1.5, 99])])
    raw = read_documents(spark, document(content))
    lost = shred.orphaned_annotations(raw["annotations"], raw["images"], raw["categories"])
    assert rows(lost, "id") == [(2,), (3,), (4,)]
    links = shred.annotation_links(raw["annotations"].where("id = 5"))
    assert rows(links) == [(5, 1), (5, 99)]
    assert rows(shred.orphaned_links(links, raw["attributes"])) == [(5, 99)]


def test_tiny_typed_set(spark, rows, document):
    """Annotations that use another key for their attributes have no links and no points."""
    anns = [{"id": 1, "image_id": 1, "category_id": 1, "area": 1000.0, "attributes": [1], "iscrowd": 0},
            {"id": 2, "image_id": 1, "category_id": 2, "area": 2000.0, "attributes": [2], "iscrowd": 0},
            {"id": 3, "image_id": 2, "category_id": 1, "area": 1500.0, "attributes": [3], "iscrowd": 0}]
    raw = read_documents(spark, document(dataset([image(1), image(2), image(3, 2)], anns)))
    kept = shred.kept_annotations(raw["annotations"], raw["images"], raw["categories"])
    assert kept.count() == 3
    assert shred.annotation_links(kept).count() == 0
    assert shred.polygon_points(kept).count() == 0



def test_a_box_is_searched_for_text_once(spark, document):
    """The types of a box are asked for once for a row, not once for each element."""
    raw = read_documents(spark, document({"annotations": [{"id": 1, "bbox": [1, 2, 3, 4]}]}))["annotations"]
    plan = shred.boxed(raw).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SchemaOfVariant.schemaOfVariant") == 1
