"""Fixed schemas: the eight tables, their keys, and the JSON members they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Column layout of the eight tables. Ids are widened to BIGINT; dates stay text.
TABLE_DDL = {
    "info": "year INT, version STRING, description STRING, contributor STRING, "
            "url STRING, date_created STRING",
    "licenses": "id BIGINT, name STRING, url STRING",
    "categories": "id BIGINT, name STRING, supercategory STRING, level INT, taxonomy_id STRING",
    "attributes": "id BIGINT, name STRING, supercategory STRING, level INT, taxonomy_id STRING",
    "images": "id BIGINT, width INT, height INT, file_name STRING, license BIGINT, "
              "time_captured STRING, original_url STRING, isstatic BOOLEAN, kaggle_id STRING",
    "annotations": "id BIGINT, image_id BIGINT, category_id BIGINT, bbox_x DOUBLE, bbox_y DOUBLE, "
                   "bbox_width DOUBLE, bbox_height DOUBLE, area DOUBLE, iscrowd BOOLEAN",
    "annotation_attributes": "annotation_id BIGINT, attribute_id BIGINT",
    "segmentations": "annotation_id BIGINT, polygon_index INT, point_index INT, "
                     "x_coord DOUBLE, y_coord DOUBLE",
}

TABLES = tuple(TABLE_DDL)

PRIMARY_KEYS = {
    "licenses": ("id",),
    "categories": ("id",),
    "attributes": ("id",),
    "images": ("id",),
    "annotations": ("id",),
    "annotation_attributes": ("annotation_id", "attribute_id"),
    "segmentations": ("annotation_id", "polygon_index", "point_index"),
}


@dataclass(frozen=True)
class Reference:
    """A column of ``child`` that must name a row of ``parent``."""

    child: str
    column: str
    parent: str
    parent_column: str = "id"
    nullable: bool = False


REFERENCES = (
    Reference("images", "license", "licenses", nullable=True),
    Reference("annotations", "image_id", "images"),
    Reference("annotations", "category_id", "categories"),
    Reference("annotation_attributes", "annotation_id", "annotations"),
    Reference("annotation_attributes", "attribute_id", "attributes"),
    Reference("segmentations", "annotation_id", "annotations"),
)

# Element layout of each JSON member as it is read. Scalars are read as text, whatever their JSON
# type, and converted afterwards, so that nothing becomes NULL unseen; nested values whose shape is
# not guaranteed are read as VARIANT, which keeps every JSON type apart.
_TAXON = "id: STRING, name: STRING, supercategory: STRING, level: STRING, taxonomy_id: STRING"
MEMBER_DDL = {
    "info": "STRUCT<year: STRING, version: STRING, description: STRING, contributor: STRING, "
            "url: STRING, date_created: STRING>",
    "licenses": "ARRAY<STRUCT<id: STRING, name: STRING, url: STRING>>",
    "categories": f"ARRAY<STRUCT<{_TAXON}>>",
    "attributes": f"ARRAY<STRUCT<{_TAXON}>>",
    "images": "ARRAY<STRUCT<id: STRING, width: STRING, height: STRING, file_name: STRING, "
              "license: STRING, time_captured: STRING, original_url: STRING, "
              "isstatic: STRING, kaggle_id: STRING>>",
    "annotations": "ARRAY<STRUCT<id: STRING, image_id: STRING, category_id: STRING, "
                   "bbox: VARIANT, area: STRING, iscrowd: STRING, "
                   "attribute_ids: VARIANT, segmentation: VARIANT>>",
}

# What the text of these scalars must convert to. Flags keep their text; see ``flag``.
MEMBER_TYPES = {
    "info": {"year": "int"},
    "licenses": {"id": "bigint"},
    "categories": {"id": "bigint", "level": "int"},
    "attributes": {"id": "bigint", "level": "int"},
    "images": {"id": "bigint", "width": "int", "height": "int", "license": "bigint"},
    "annotations": {"id": "bigint", "image_id": "bigint", "category_id": "bigint", "area": "double"},
}

MEMBERS = tuple(MEMBER_DDL)


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLE_DDL[name])


def member_schema(*names: str) -> T.StructType:
    """Schema of a document restricted to the given members, so the rest is skipped."""
    return T.StructType.fromDDL(", ".join(f"{n}: {MEMBER_DDL[n]}" for n in names))


def element_schema(name: str) -> T.StructType:
    """Schema of one element of a member (the member itself for ``info``)."""
    kind = member_schema(name)[name].dataType
    return kind.elementType if isinstance(kind, T.ArrayType) else kind
