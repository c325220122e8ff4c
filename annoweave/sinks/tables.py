"""Writers for the eight tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from annoweave.schemas import table_schema
from annoweave.sources.tables import CSV_OPTIONS

FILE_FORMATS = ("parquet", "csv", "json", "orc")


def _declared(name: str, df: DataFrame) -> DataFrame:
    """The columns the table declares, in order and with the declared types."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in table_schema(name)])


def write_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """Write one folder per table below ``root``.

    ``overwrite`` replaces a table, ``append`` adds to it. An empty table is
    written too, with its schema, so no older rows can stand in for it.
    """
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown file format: {fmt}")
    for name, df in tables.items():
        writer = _declared(name, df).write.mode(mode)
        if fmt == "csv":
            writer = writer.options(**CSV_OPTIONS)
        writer.format(fmt).save(f"{root.rstrip('/')}/{name}")


def export_csv(tables: Mapping[str, DataFrame], root: str) -> None:
    """CSV with a header line and comma separators, one folder per table."""
    write_tables(tables, root, "csv")


def save_tables(tables: Mapping[str, DataFrame], database: str, mode: str = "overwrite") -> None:
    """Write the tables into a catalog database; ``overwrite`` replaces the rows."""
    for name, df in tables.items():
        _declared(name, df).write.insertInto(f"`{database}`.`{name}`", overwrite=mode == "overwrite")


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder of this toolkit's own staging files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files below a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(target).getLength()
