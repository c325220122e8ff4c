import json
from dataclasses import replace
from pathlib import Path

import pytest

from annoweave.__main__ import main
from annoweave.operators import integrity, reports
from annoweave.plans.load import (
    CHECKED, UNCHECKED, compare_loads, load_documents, load_lines, read_rejects, rejects_report)
from annoweave.plans.report import comparison_report, dataset_report
from annoweave.schemas import TABLES, table_schema
from annoweave.session import clear_scratch, shared_folder
from annoweave.sinks.tables import export_csv, save_tables, write_tables
from annoweave.sources.tables import catalog_tables, create_tables, existing_tables, read_tables
from conftest import annotation, dataset, image


def counts(tables):
    return {r["table"]: r.rows for r in reports.table_counts(tables).collect()}


def test_single_row_load_and_export(spark, document, tmp_path):
    content = dataset([image(1)], [annotation(1, 1)])
    tables = load_documents(spark, document(content), str(tmp_path / "out"))
    assert counts(tables) == {"info": 1, "licenses": 2, "categories": 3, "attributes": 3, "images": 1,
                              "annotations": 1, "annotation_attributes": 1, "segmentations": 3}
    for name in TABLES:
        assert [(f.name, f.dataType) for f in tables[name].schema] == [
            (f.name, f.dataType) for f in table_schema(name)]
    export_csv(tables, str(tmp_path / "csv"))
    back = read_tables(spark, str(tmp_path / "csv"), "csv")
    for name in TABLES:
        assert sorted(back[name].collect()) == sorted(tables[name].collect())


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, document, tmp_path, fmt):
    content = dataset([image(1), image(2, 0)], [annotation(1, 1), annotation(2, 2, 2)])
    tables = load_documents(spark, document(content), str(tmp_path / "out"), fmt=fmt)
    assert counts(tables)["segmentations"] == 6
    assert sorted((r.id, r.license) for r in tables["images"].collect()) == [(1, 1), (2, None)]
    with pytest.raises(ValueError):
        write_tables(tables, str(tmp_path / "x"), "excel")


def test_checked_and_unchecked(spark, document, tmp_path):
    odd = {**annotation(3, 1), "attribute_ids": [1, 99], "segmentation": [["1.5", 2, 3, 4, 5]]}
    content = dataset([image(1, 0)], [annotation(1, 1), annotation(2, 77), odd],
                      licenses=[{"id": 0, "name": "none"}, {"id": 1, "name": "one"}])
    path = document(content)
    checked = load_documents(spark, path, str(tmp_path / "a"), CHECKED)
    unchecked = load_documents(spark, path, str(tmp_path / "b"), UNCHECKED)
    assert counts(checked) == {"info": 1, "licenses": 1, "categories": 3, "attributes": 3, "images": 1,
                               "annotations": 2, "annotation_attributes": 2, "segmentations": 4}
    assert counts(unchecked) == {"info": 1, "licenses": 2, "categories": 3, "attributes": 3, "images": 1,
                                 "annotations": 3, "annotation_attributes": 4, "segmentations": 8}
    assert checked["images"].first().license is None and unchecked["images"].first().license == 0
    assert sum(r.violations for r in integrity.reference_audit(checked).collect()) == 0
    assert spark.read.parquet(str(tmp_path / "a/rejects/points")).count() == 1
    assert spark.read.parquet(str(tmp_path / "b/rejects/points")).count() == 0


def test_empty_members_replace_older_rows(spark, document, tmp_path):
    out = str(tmp_path / "out")
    load_documents(spark, document(dataset([image(1)], [annotation(1, 1)])), out)
    tables = load_documents(spark, document({"info": {"year": 1}}, "b.json"), out)
    assert counts(tables) == {n: 1 if n == "info" else 0 for n in TABLES}


def test_append_adds_rows(spark, document, tmp_path):
    tables = load_documents(spark, document(dataset([image(1)], [])), str(tmp_path / "a"))
    write_tables(tables, str(tmp_path / "b"))
    write_tables(tables, str(tmp_path / "b"), mode="append")
    assert counts(read_tables(spark, str(tmp_path / "b")))["images"] == 2


def test_staging_is_kept_only_on_request(spark, document, tmp_path, monkeypatch):
    path = document(dataset([image(1)], [annotation(1, 1)]))
    load_documents(spark, path, str(tmp_path / "a"), staging=str(tmp_path / "kept"))
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == [
        "annotations", "documents", "images", "kept"]
    import annoweave.plans.load as load
    monkeypatch.setattr(load, "scratch_path", lambda s, label: str(tmp_path / "gone"))
    load_documents(spark, path, str(tmp_path / "b"))
    assert not (tmp_path / "gone").exists()


def test_several_documents(spark, tmp_path):
    for part in range(3):
        content = {"images": [image(part)], "annotations": [annotation(part, part)],
                   "categories": dataset([], [])["categories"] if part == 0 else []}
        (tmp_path / f"d{part}.json").write_text(json.dumps(content))
    tables = load_documents(spark, f"{tmp_path}/d*.json", str(tmp_path / "out"))
    assert counts(tables)["annotations"] == 3


def test_lines_load_like_documents(spark, document, tmp_path):
    content = dataset([image(1), image(2, 2)], [annotation(1, 1), annotation(2, 2, 3, [2, 3])])
    folder = tmp_path / "lines"
    folder.mkdir()
    for name, member in content.items():
        if name != "info":
            (folder / f"{name}.jsonl").write_text("\n".join(json.dumps(e) for e in member))
    by_line = load_lines(spark, str(folder), str(tmp_path / "a"))
    whole = load_documents(spark, document(content), str(tmp_path / "b"))
    for name in TABLES:
        expected = [] if name == "info" else sorted(whole[name].collect())
        assert sorted(by_line[name].collect()) == expected


def test_sampled_load_of_a_large_document(spark, document, tmp_path):
    content = dataset([image(i + 1, 1 + i % 2) for i in range(12_000)],
                      [annotation(i + 1, i % 12_000 + 1, 1 + i % 2, [1 + i % 2]) for i in range(15_000)])
    path = document(content)
    whole = load_documents(spark, path, str(tmp_path / "full"))  # every row, whatever the size
    assert counts(whole)["images"] == 12_000 and counts(whole)["segmentations"] == 45_000
    part = load_documents(spark, path, str(tmp_path / "part"), replace(CHECKED, sample_size=1000))
    found = counts(part)
    assert found["images"] == 1000 and 800 <= found["annotations"] <= 1000
    assert found["segmentations"] == 3 * found["annotations"] == 3 * found["annotation_attributes"]
    assert sorted(r[0] for r in part["images"].groupBy("license").count().select("count").collect()) == [500, 500]
    for name in ("licenses", "categories", "attributes"):
        assert sorted(part[name].collect()) == sorted(whole[name].collect())
    assert sum(r.violations for r in integrity.reference_audit(part).collect()) == 0
    small = counts(load_documents(spark, path, str(tmp_path / "small"), replace(CHECKED, small_dataset_mode=True)))
    assert small["images"] == 100 and small["annotations"] <= 200
    report = comparison_report(spark, str(tmp_path / "full"), str(tmp_path / "part"))
    rows = {r["table"]: r for r in report["counts"].collect()}
    assert rows["images"].ratio == 1000 / 12_000 and rows["categories"].ratio == 1.0
    assert {r.metric for r in report["density"].collect()} >= {"unique_images", "annotations_per_image"}
    assert report["coverage"].count() == 3 and report["preview_info"].count() == 2


def test_what_is_left_out_is_told(spark, document, tmp_path):
    odd = [annotation(2, 99), {**annotation(3, 1), "area": "wide"}, {**annotation(4, 1), "bbox": [1]},
           annotation(5, 1, 1, [1, 77])]
    path = document(dataset([image(1, 0)], [annotation(1, 1), *odd]))
    out = str(tmp_path / "out")
    load_documents(spark, path, out)
    assert {r.kind: r.rows for r in rejects_report(spark, out).collect()} == {
        "damaged": 0, "unconverted": 1, "boxes": 1, "points": 0, "annotations": 1, "links": 1}
    assert read_rejects(spark, out, "licenses").first()[0] == 1
    assert read_rejects(spark, out, "annotations").first().image_id == 99
    strict = replace(CHECKED, fail_on_rejects=True)
    with pytest.raises(ValueError, match="wide"):
        load_documents(spark, path, str(tmp_path / "strict"), strict)
    (tmp_path / "torn.json").write_text('{"images": [')
    with pytest.raises(ValueError, match="damaged"):
        load_documents(spark, str(tmp_path / "torn.json"), str(tmp_path / "strict"), strict)
    load_documents(spark, document(dataset([image(1)], [annotation(1, 1)]), "good.json"),
                   str(tmp_path / "strict"), strict)


def test_all_images_and_a_sample_of_annotations(spark, document, tmp_path):
    path = document(dataset([image(i) for i in range(50)], [annotation(i, i % 50) for i in range(300)]))
    options = replace(UNCHECKED, sample_size=20, all_images=True)
    found = counts(load_documents(spark, path, str(tmp_path / "out"), options))
    assert (found["images"], found["annotations"], found["segmentations"]) == (50, 20, 60)


def test_no_scratch_is_left(spark, document, tmp_path):
    clear_scratch(spark)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("annoweave-*"))
    path = document(dataset([image(1)], [annotation(1, 1)]))
    tables = load_documents(spark, path, str(tmp_path / "out"))
    clear_scratch(spark)
    assert set(folder.glob("annoweave-*")) <= before
    assert counts(tables)["images"] == 1


def test_catalog(spark, document):
    path = document(dataset([image(1)], [annotation(1, 1)]))
    tables = load_documents(spark, path, "wardrobe", fmt="catalog")
    try:
        assert counts(tables)["segmentations"] == 3
        assert spark.table("wardrobe.rejected_points").count() == 0
        create_tables(spark, "wardrobe")
        save_tables({"images": catalog_tables(spark, "wardrobe")["images"].limit(0).unionByName(
            spark.createDataFrame([], table_schema("images")))}, "wardrobe", mode="append")
        assert counts(catalog_tables(spark, "wardrobe"))["images"] == 1
    finally:
        spark.sql("DROP DATABASE wardrobe CASCADE")


def test_reports_on_a_load(spark, document, tmp_path):
    anns = [annotation(i, 1, 1 + (i > 3), [1, 2] if i == 1 else [2]) for i in range(1, 6)]
    tables = load_documents(spark, document(dataset([image(1), image(2, 2)], anns)), str(tmp_path / "o"))
    report = dataset_report(tables)
    assert [(r.id, r["count"]) for r in report["top_categories"].collect()] == [(1, 3), (2, 2), (3, 0)]
    assert [(r.id, r["count"]) for r in report["top_attributes"].collect()] == [(2, 5), (1, 1), (3, 0)]
    assert report["statistics"].first().total_annotations == 5
    assert sum(r.violations for r in report["key_audit"].collect()) == 0


def test_load_methods_are_compared(spark, document, tmp_path):
    path = document(dataset([image(1)], [annotation(1, 1)]))
    found = {r.measure: r for r in compare_loads(spark, path, str(tmp_path / "cmp")).collect()}
    assert set(found) == {"seconds", "bytes"} and found["bytes"].base > 0


def test_absent_tables_are_reported(spark, document, tmp_path):
    tables = load_documents(spark, document(dataset([image(1)], [annotation(1, 1)])), str(tmp_path / "a"))
    write_tables({n: tables[n] for n in ("images", "categories")}, str(tmp_path / "b"))
    assert sorted(existing_tables(spark, str(tmp_path / "b"))) == ["categories", "images"]
    report = comparison_report(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert "density" not in report
    errors = {r["table"]: r.error for r in report["columns"].collect()}
    assert errors["images"] is None and errors["annotations"] == "table not found"


def test_command_line(spark, document, tmp_path, capsys):
    path = document(dataset([image(1)], [annotation(1, 1)]))
    out = str(tmp_path / "out")
    main(["load", path, out])
    main(["export", out, str(tmp_path / "csv")])
    main(["report", out])
    main(["compare", out, out])
    categories = tmp_path / "c.json"
    categories.write_text(json.dumps(dataset([], [])["categories"]))
    main(["ontology", str(categories), str(tmp_path / "owl"), "--dataset", "Wardrobe"])
    shown = capsys.readouterr().out
    assert "top_categories" in shown and "density" in shown and "summary" in shown and "left out" in shown
