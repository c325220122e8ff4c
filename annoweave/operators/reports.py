"""Statistics and top-k reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of every table, as one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


# Tables whose counts are also reported as totals.
TOTALS = ("annotations", "images", "categories", "attributes")


def table_statistics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: ``<table>_count`` for every table and ``total_<table>`` for four of them."""
    def pick(name: str):
        return F.coalesce(F.max(F.when(F.col("table") == name, F.col("rows"))), F.lit(0))
    columns = [pick(name).alias(f"{name}_count") for name in tables]
    columns += [pick(name).alias(f"total_{name}") for name in TOTALS]
    return table_counts(tables).agg(*columns)


def usage_counts(items: DataFrame, uses: DataFrame, item_key: str, use_key: str, *,
                 counted: str | None = None) -> DataFrame:
    """Every item with the number of rows that use it, zero included, as ``count``.

    Uses are counted before the join: what is shuffled is one partial count per
    key and task, however many rows a single key holds.
    """
    rows = F.count(F.lit(1) if counted is None else F.col(counted))
    counts = (uses.where(F.col(use_key).isNotNull()).groupBy(F.col(use_key).alias("_key"))
                  .agg(rows.alias("_uses")))
    joined = items.join(counts, F.col(item_key) == F.col("_key"), "left")
    return joined.withColumn("count", F.coalesce("_uses", F.lit(0))).drop("_key", "_uses")


def top_used(usage: DataFrame, item_key: str, limit: int = 10) -> DataFrame:
    """The most used items; ties go to the lower key."""
    return usage.orderBy(F.desc("count"), item_key).limit(limit)


def image_summary(images: DataFrame, *, width: str = "width", height: str = "height",
                  license: str = "license") -> DataFrame:
    """Row count, mean size and number of distinct non-null licenses."""
    return images.agg(
        F.count(F.lit(1)).alias("total_images"), F.avg(width).alias("avg_width"),
        F.avg(height).alias("avg_height"), F.count_distinct(license).alias("unique_licenses"))


def _matched(parents: DataFrame, children: DataFrame, parent_id: str, child_key: str,
             counted: str) -> DataFrame:
    """One row per parent id: its rows (``times``) and its children (``children``)."""
    per_parent = (children.where(F.col(child_key).isNotNull())
                  .groupBy(F.col(child_key).alias("_key"))
                  .agg(F.count(counted).alias("_children")))
    unique = parents.groupBy(parent_id).agg(F.count(F.lit(1)).alias("times"))
    joined = unique.join(per_parent, F.col(parent_id) == F.col("_key"), "left")
    return joined.withColumn("children", F.coalesce("_children", F.lit(0)))


def relationship_density(images: DataFrame, annotations: DataFrame, *, image_id: str = "id",
                         annotation_image: str = "image_id",
                         annotation_id: str = "id") -> DataFrame:
    """Distinct images, their annotations, and annotations per image (whole and exact)."""
    pairs = _matched(images, annotations, image_id, annotation_image, annotation_id)
    totals = pairs.agg(
        F.count(image_id).alias("unique_images"),
        F.coalesce(F.sum(F.col("times") * F.col("children")), F.lit(0)).alias("total_annotations"))
    return totals.select(
        "*", F.expr("total_annotations div nullif(unique_images, 0)").alias("annotations_per_image"),
        F.try_divide(F.col("total_annotations").cast("double"),
                     F.col("unique_images").cast("double")).alias("mean_annotations_per_image"))


def segmentation_coverage(annotations: DataFrame, segmentations: DataFrame, *,
                          annotation_id: str = "id", point_key: str = "annotation_id") -> DataFrame:
    """Distinct annotations, how many have points, and the points they have.

    ``annotations_joined`` counts all annotations, as an outer join does;
    ``annotations_with_points`` is the coverage proper.
    """
    pairs = _matched(annotations, segmentations, annotation_id, point_key, point_key)
    points = F.col("times") * F.col("children")
    covered = F.when(F.col("children") > 0, F.col(annotation_id))
    return pairs.agg(
        F.count(annotation_id).alias("annotations_joined"),
        F.count(covered).alias("annotations_with_points"),
        F.coalesce(F.sum(points), F.lit(0)).alias("total_points"))
