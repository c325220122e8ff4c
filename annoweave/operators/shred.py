"""Raw members to typed tables.

Rows that cannot be shredded are not lost: boxes of the wrong shape and pairs of
non-numeric coordinates each have a reject report that is the exact complement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoweave.functions.scalars import (
    flag, may_hold_text, unextracted, variant_list, variant_numbers, variant_polygons,
    whole_numbers, zero_to_null)
from annoweave.operators.joins import keep_matching, keep_unmatched

_TAXON = ("id", "name", "supercategory", "level", "taxonomy_id")


def _is_variant(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.VariantType)


def info_table(raw: DataFrame) -> DataFrame:
    return raw.select("year", "version", "description", "contributor", "url", "date_created")


def licenses_table(raw: DataFrame, drop_zero: bool = True) -> DataFrame:
    """Licenses; id zero, as number or text, is a placeholder and is dropped."""
    typed = raw.select("id", "name", "url")
    return typed.where(~F.col("id").eqNullSafe(0)) if drop_zero else typed


def categories_table(raw: DataFrame) -> DataFrame:
    return raw.select(*_TAXON)


def attributes_table(raw: DataFrame) -> DataFrame:
    return raw.select(*_TAXON)


def images_table(raw: DataFrame, null_zero: bool = True) -> DataFrame:
    """Images; the placeholder license zero becomes NULL."""
    return raw.select(
        "id", "width", "height", "file_name",
        (zero_to_null("license") if null_zero else F.col("license")).alias("license"),
        "time_captured", "original_url", flag("isstatic").alias("isstatic"), "kaggle_id")


def zero_license_count(raw: DataFrame) -> DataFrame:
    """How many images carry the placeholder license."""
    return raw.agg(F.count_if(F.col("license") == 0).alias("nullified"))


def _box_numbers(raw: DataFrame) -> Column:
    """The box as numbers, zeros when absent."""
    zeros = F.array(*[F.lit(0.0)] * 4)
    box = F.col("bbox")
    if _is_variant(raw, "bbox"):
        box = F.try_variant_get(box, "$", "array<double>")
    return F.when(F.col("bbox").isNull(), zeros).otherwise(box)


def _box_is_usable(raw: DataFrame) -> Column:
    """Whether the box is absent or has four elements, each a number or a JSON null."""
    usable = F.size(_box_numbers(raw)) == 4
    if _is_variant(raw, "bbox"):
        # Only a box with text in it needs a look at each element; whether it has is asked once for a row.
        plain = F.lit(True)
        for i in range(4):
            item = F.try_variant_get(unextracted("bbox"), f"$[{i}]", "variant")
            number = F.try_variant_get(unextracted("bbox"), f"$[{i}]", "double")
            plain = plain & (number.isNotNull() | F.is_variant_null(item))
        usable = usable & (~may_hold_text("bbox") | plain)
    return F.col("bbox").isNull() | F.coalesce(usable, F.lit(False))


def boxed(raw: DataFrame) -> DataFrame:
    """Annotations whose box is absent or has exactly four numbers."""
    return raw.where(_box_is_usable(raw))


def rejected_boxes(raw: DataFrame) -> DataFrame:
    """Annotations left out because their box has the wrong shape."""
    return raw.where(~_box_is_usable(raw)).select("id", F.col("bbox").cast("string").alias("bbox"))


def kept_annotations(raw: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Raw annotations whose image and category both exist."""
    found = keep_matching(raw, categories, "category_id", "id")
    return keep_matching(found, images, "image_id", "id")


def orphaned_annotations(raw: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """The complement: annotations that name no image or no category, and which they name."""
    known = [side.select(F.col("id").alias(f"_{name}")).where("id is not null").distinct()
             for name, side in (("image", images), ("category", categories))]
    marked = (raw.select("id", "image_id", "category_id")
              .join(known[0], F.col("image_id") == F.col("_image"), "left")
              .join(known[1], F.col("category_id") == F.col("_category"), "left"))
    return marked.where("_image is null or _category is null").select("id", "image_id", "category_id")


def annotations_table(raw: DataFrame) -> DataFrame:
    """Typed annotations, the box split into four columns."""
    box = [F.get("_box", F.lit(i)).alias(n)
           for i, n in enumerate(("bbox_x", "bbox_y", "bbox_width", "bbox_height"))]
    usable = boxed(raw)
    return usable.withColumn("_box", _box_numbers(usable)).select(
        "id", "image_id", "category_id", *box, "area", flag("iscrowd").alias("iscrowd"))


def annotation_links(raw: DataFrame, numbers_only: bool = True) -> DataFrame:
    """One row per attribute id of an annotation; no list gives no rows.

    Ids written as text do not name an attribute unless ``numbers_only`` is off, and numbers that are not
    whole never do.
    """
    listed = F.col("attribute_ids")
    if _is_variant(raw, "attribute_ids"):
        listed = whole_numbers(variant_numbers("attribute_ids", "decimal(38,9)", numbers_only))
    # Converted in a projection of its own, which the Parquet scan can do. The outer
    # form leaves out the size test that would convert the list twice.
    lists = raw.select(F.col("id").alias("annotation_id"), listed.alias("_listed"))
    links = lists.select("annotation_id", F.explode_outer("_listed").alias("attribute_id"))
    return links.where("attribute_id is not null")


def known_links(links: DataFrame, attributes: DataFrame) -> DataFrame:
    """Links whose attribute exists."""
    return keep_matching(links, attributes, "attribute_id", "id")


def orphaned_links(links: DataFrame, attributes: DataFrame) -> DataFrame:
    """Links that name no attribute."""
    return keep_unmatched(links, attributes, "attribute_id", "id")


def _polygons(raw: DataFrame, strict: bool) -> DataFrame:
    """One row per polygon, its values as numbers; converted once, before unfolding."""
    found = F.col("segmentation")
    numbers = (variant_polygons(found, strict) if _is_variant(raw, "segmentation")
               else found.cast("array<array<double>>"))
    converted = raw.select(F.col("id").alias("annotation_id"), "segmentation",
                           numbers.alias("_converted"))
    return converted.select("annotation_id", "segmentation",
                            F.posexplode_outer("_converted").alias("polygon_index", "_numbers"))


def _pairs(polygons: DataFrame) -> DataFrame:
    """The x, y pairs of polygons, as numbers and as found."""
    variant = _is_variant(polygons, "segmentation")
    last = F.expr("cast(size(_numbers) div 2 - 1 as int)")
    indexes = F.when(F.size("_numbers") >= 2, F.sequence(F.lit(0), last))
    x_at, y_at = F.col("point_index") * 2, F.col("point_index") * 2 + 1
    source = variant_list("segmentation") if variant else F.col("segmentation")
    source = F.get(source, F.col("polygon_index"))
    source = variant_list(source) if variant else source
    return (polygons.select("*", F.explode_outer(indexes).alias("point_index"))
                    .where("point_index is not null")
                    .select("annotation_id", "polygon_index", "point_index",
                            F.get(source, x_at).alias("x"), F.get(source, y_at).alias("y"),
                            F.get("_numbers", x_at).alias("x_coord"),
                            F.get("_numbers", y_at).alias("y_coord")))


def coordinate_pairs(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Every x, y pair of every polygon; an odd last value has no pair.

    ``x`` and ``y`` are the values as found, ``x_coord`` and ``y_coord`` the same
    as numbers, NULL where they are not numeric. Works on typed nested arrays and
    on variants. In a variant anything but a list of lists (a run-length object,
    say) has no pairs.
    """
    return _pairs(_polygons(raw, strict))


def polygon_points(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Point rows; a pair that is not numeric is left out and its index stays unused."""
    return (coordinate_pairs(raw, strict)
            .where("x_coord is not null and y_coord is not null")
            .select("annotation_id", "polygon_index", "point_index", "x_coord", "y_coord"))


def rejected_points(raw: DataFrame, strict: bool = True) -> DataFrame:
    """The pairs ``polygon_points`` left out, as text.

    Only polygons that hold such a value are unfolded.
    """
    odd = _polygons(raw, strict).where(F.exists("_numbers", lambda number: number.isNull()))
    return (_pairs(odd).where("x_coord is null or y_coord is null")
            .select("annotation_id", "polygon_index", "point_index",
                    F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y")))
