"""Which folders make up the tables of a published dataset; see ``sinks.versions``."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from annoweave.session import path_exists

_NUMBER = re.compile(r"^(\d{12})\.json$")
EMPTY: dict = {"number": 0, "format": None, "loads": [], "tables": {}, "keys": {}}


def hadoop_file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def file_names(spark: SparkSession, folder: str) -> list[str]:
    if not path_exists(spark, folder):
        return []
    files, target = hadoop_file(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(target)]


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest manifest below ``root``, or an empty one."""
    folder = f"{root.rstrip('/')}/_manifests"
    numbers = [m[1] for m in map(_NUMBER.match, file_names(spark, folder)) if m]
    if not numbers:
        return dict(EMPTY)
    text = spark.read.text(f"{folder}/{max(numbers)}.json", wholetext=True).first()[0]
    return {**json.loads(text), "number": int(max(numbers))}


def folders(spark: SparkSession, root: str, name: str) -> list[str] | None:
    """The folders that make up a published table; None if nothing is published below ``root``."""
    found = manifest(spark, root)
    if not found["number"]:
        return None
    return [f"{root.rstrip('/')}/{folder}" for folder in found["tables"].get(name, [])]
