"""Reader for category lists in JSON lines or JSON array form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.schemas import element_schema
from annoweave.sources.documents import WHOLE_FILES, typed


def _as_found(spark: SparkSession, path: str) -> DataFrame:
    schema = element_schema("categories").add("_corrupt_record", "string")
    return spark.read.schema(schema).options(**({} if path.endswith(".jsonl") else WHOLE_FILES)).json(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Categories from ``*.jsonl`` (one object per line) or from a JSON array.

    Lines that are not JSON and values of the wrong kind are in ``unreadable_categories``.
    """
    found = _as_found(spark, path).where("_corrupt_record is null").drop("_corrupt_record")
    return typed(found, "categories")[0]


def unreadable_categories(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_categories`` leaves out, as text."""
    found = _as_found(spark, path)
    odd = typed(found.where("_corrupt_record is null").drop("_corrupt_record"), "categories")[1]
    return (found.where("coalesce(_corrupt_record, id) = _corrupt_record").select(F.col("_corrupt_record").alias("row"))
            .unionByName(odd.select("row")))


def complete_categories(categories: DataFrame) -> DataFrame:
    """Categories that have every key the taxonomy needs."""
    return categories.where(_missing_any() == F.lit(False))


def incomplete_categories(categories: DataFrame) -> DataFrame:
    """The complement: categories that cannot be turned into triples."""
    return categories.where(_missing_any())


def _missing_any():
    parts = [F.col(f.name).isNull() for f in element_schema("categories")]
    missing = parts[0]
    for part in parts[1:]:
        missing = missing | part
    return missing
