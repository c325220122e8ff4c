import pytest

from annoweave.functions.scalars import percent_change, ratio
from annoweave.operators import compare, integrity, reports
from annoweave.sources.tables import ids, preview
from pyspark.sql import functions as F


@pytest.fixture
def tiny(spark):
    """3 images, 3 annotations, 3 categories, one of them unused."""
    return {
        "images": spark.createDataFrame([(1, 640, 480, 1), (2, 1280, 720, 1), (3, 640, 360, 2)],
                                        "id long, width int, height int, license long"),
        "annotations": spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1)],
                                             "id long, image_id long, category_id long"),
        "categories": spark.createDataFrame([(1, "tug", "w"), (2, "buoy", "m"), (3, "ferry", "w")],
                                            "id long, name string, supercategory string"),
        "segmentations": spark.createDataFrame([(1, 0, 0), (1, 0, 1), (7, 0, 0)],
                                               "annotation_id long, polygon_index int, point_index int"),
    }


def test_usage_is_zero_filled_and_ties_go_to_the_lower_key(tiny, rows):
    usage = reports.usage_counts(tiny["categories"], tiny["annotations"], "id", "category_id", counted="id")
    assert rows(usage, "id", "count") == [(1, 2), (2, 1), (3, 0)]
    flat = usage.withColumn("count", F.lit(1))
    assert [r.id for r in reports.top_used(flat, "id", 2).collect()] == [1, 2]


def test_same_named_items_stay_apart(spark, rows):
    items = spark.createDataFrame([(1, "x"), (2, "x")], "id long, name string")
    uses = spark.createDataFrame([(2,), (2,), (None,)], "k long")
    assert rows(reports.usage_counts(items, uses, "id", "k"), "id", "count") == [(1, 0), (2, 2)]


def test_image_summary(tiny, spark):
    r = reports.image_summary(tiny["images"]).first()
    assert (r.total_images, round(r.avg_width, 2), r.avg_height, r.unique_licenses) == (3, 853.33, 520.0, 2)
    empty = reports.image_summary(tiny["images"].limit(0)).first()
    assert (empty.total_images, empty.avg_width, empty.unique_licenses) == (0, None, 0)


def test_statistics(tiny):
    r = reports.table_statistics(tiny).first()
    assert r.images_count == r.total_images == 3 and r.segmentations_count == 3
    assert r.total_attributes == 0


def test_density(tiny, spark):
    r = reports.relationship_density(tiny["images"], tiny["annotations"]).first()
    assert (r.unique_images, r.total_annotations, r.annotations_per_image, r.mean_annotations_per_image) == (3, 3, 1, 1.0)
    twice = tiny["images"].union(tiny["images"].where("id = 1"))
    r = reports.relationship_density(twice, tiny["annotations"]).first()
    assert (r.unique_images, r.total_annotations) == (3, 5)
    none = reports.relationship_density(tiny["images"].limit(0), tiny["annotations"]).first()
    assert (none.unique_images, none.total_annotations, none.annotations_per_image) == (0, 0, None)


def test_coverage(tiny):
    r = reports.segmentation_coverage(tiny["annotations"], tiny["segmentations"]).first()
    assert (r.annotations_joined, r.annotations_with_points, r.total_points) == (3, 1, 2)


def test_audits(tiny, rows):
    tables = {**tiny, "licenses": tiny["categories"].where("id = 1").select("id")}
    found = {(r["table"], r["column"]): r.violations for r in integrity.reference_audit(tables).collect()}
    assert found[("images", "license")] == 1
    assert found[("annotations", "image_id")] == found[("annotations", "category_id")] == 0
    assert found[("segmentations", "annotation_id")] == 1
    keys = {r["table"]: r.violations for r in integrity.key_audit(
        {**tiny, "images": tiny["images"].union(tiny["images"])}).collect()}
    assert keys["images"] == 3 and keys["annotations"] == 0
    assert integrity.orphans(tiny["segmentations"], tiny["annotations"], "annotation_id").count() == 1
    assert integrity.missing_from(tiny["annotations"].select(F.col("image_id").alias("id")),
                                  tiny["images"], "id").count() == 0


def test_guarded_arithmetic(spark, rows):
    df = spark.createDataFrame([(1, 4, 1), (2, 0, 3)], "id int, a int, b int")
    assert rows(df, "id", ratio("b", "a")) == [(1, 0.25), (2, 0.0)]
    assert rows(df, "id", percent_change("a", "b")) == [(1, -75.0), (2, None)]


def test_comparison(tiny, spark, rows):
    part = {"images": tiny["images"].where("id < 3"), "annotations": tiny["annotations"].where("id = 1")}
    counts = {r["table"]: (r.full, r["sample"], r.ratio) for r in compare.compare_counts(tiny, part).collect()}
    assert counts["images"] == (3, 2, 2 / 3) and counts["categories"] == (3, 0, 0.0)
    columns = {r["table"]: r for r in compare.compare_columns(spark, tiny, part).collect()}
    assert columns["images"].error is None and columns["images"].sample_columns == 4
    assert columns["categories"].error == "table not found"
    density = {r.metric: (r.full, r["sample"]) for r in compare.compare_density(tiny, part).collect()}
    assert density["unique_images"] == (3.0, 2.0)
    assert density["annotations_per_image"] == (1.0, 0.0)
    shown = compare.compare_previews(tiny["images"], part["images"], "id", rows=1).collect()
    assert [(r.side, r.id) for r in shown] == [("full", 1), ("sample", 1)]
    metrics = spark.createDataFrame([("a", 2.0, 10), ("b", 3.0, 5)], "method string, seconds double, bytes long")
    diff = {r.measure: r.percent_change for r in
            compare.compare_methods(metrics, "method", "a", "b", "seconds", "bytes").collect()}
    assert diff == {"seconds": 50.0, "bytes": -50.0}


def test_ids_and_preview(tiny, rows):
    assert rows(ids(tiny["annotations"], "image_id")) == [(1,), (2,)]
    assert [r.id for r in preview(tiny["images"], "id", 2).collect()] == [1, 2]
