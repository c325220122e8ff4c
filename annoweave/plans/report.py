"""The reports on stored datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annoweave.operators import compare, integrity, reports
from annoweave.schemas import PRIMARY_KEYS, TABLES
from annoweave.sources.tables import Tables, existing_tables

def dataset_report(tables: Tables) -> dict[str, DataFrame]:
    """Counts, the two usage rankings, the image summary and the audits."""
    categories = reports.usage_counts(tables["categories"], tables["annotations"], "id",
                                      "category_id", counted="id")
    attributes = reports.usage_counts(tables["attributes"], tables["annotation_attributes"], "id",
                                      "attribute_id", counted="annotation_id")
    shown = ("name", "supercategory", "count")
    return {
        "statistics": reports.table_statistics(tables),
        "top_categories": reports.top_used(categories, "id").select("id", *shown),
        "top_attributes": reports.top_used(attributes, "id").select("id", *shown),
        "image_summary": reports.image_summary(tables["images"]),
        "reference_audit": integrity.reference_audit(tables),
        "key_audit": integrity.key_audit(tables),
    }


def comparison_report(spark: SparkSession, full_root: str, sample_root: str,
                      fmt: str = "parquet") -> dict[str, DataFrame]:
    """Counts, columns, previews, density and coverage of a full and a sampled dataset."""
    full, sample = (existing_tables(spark, root, fmt) for root in (full_root, sample_root))
    report = {"counts": compare.compare_counts(full, sample),
              "columns": compare.compare_columns(spark, full, sample)}
    for name in (n for n in TABLES if n in full and n in sample):
        keys = PRIMARY_KEYS.get(name, ("year", "version", "url"))
        report[f"preview_{name}"] = compare.compare_previews(full[name], sample[name], *keys)
    if all({"images", "annotations"} <= t.keys() for t in (full, sample)):
        report["density"] = compare.compare_density(full, sample)
    if all({"annotations", "segmentations"} <= t.keys() for t in (full, sample)):
        report["coverage"] = compare.compare_coverage(full, sample)
    return report
