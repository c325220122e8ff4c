"""Readers and declarations for the eight stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annoweave.schemas import TABLE_DDL, TABLES, table_schema
from annoweave.session import path_exists
from annoweave.sources.manifests import folders

Tables = dict[str, DataFrame]

# Quotes are doubled inside quoted values; line breaks in them are part of the value. NULL and empty
# text are both an empty field, and are read as NULL.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": "",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One stored table with its declared schema, as last published or as plainly written below ``root``."""
    reader = spark.read.schema(table_schema(name))
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS, multiLine=True, mode="FAILFAST")
    published = folders(spark, root, name)
    if published == []:
        return spark.createDataFrame([], table_schema(name))
    return reader.format(fmt).load(published or f"{root.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    return {name: read_table(spark, root, name, fmt) for name in TABLES}


def create_tables(spark: SparkSession, database: str, fmt: str = "parquet") -> None:
    """Declare the eight tables in a catalog database.

    Spark enforces neither primary nor foreign keys; ``integrity`` audits them.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, ddl in TABLE_DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({ddl}) USING {fmt}")


def catalog_tables(spark: SparkSession, database: str) -> Tables:
    return {name: spark.table(f"`{database}`.`{name}`") for name in TABLES}


def ids(df: DataFrame, column: str = "id") -> DataFrame:
    """The distinct ids of a table; only that column is read."""
    return df.select(column).distinct()


def preview(df: DataFrame, key: str, rows: int = 3) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(rows)


def existing_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """The stored tables that are there; absent ones are left out."""
    there = [n for n in TABLES if folders(spark, root, n) or path_exists(spark, f"{root.rstrip('/')}/{n}")]
    return {name: read_table(spark, root, name, fmt) for name in there}
