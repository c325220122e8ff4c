"""Audits for the keys and references Spark does not enforce."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoweave.operators.joins import keep_unmatched
from annoweave.schemas import PRIMARY_KEYS, REFERENCES, Reference


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Child rows that name no parent row."""
    return keep_unmatched(child, parent, child_key, parent_key)


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: str,
                parent_key: str = "id") -> DataFrame:
    """The missing parent keys and how many child rows name each.

    Child rows are counted by key first, so a key held by many rows is one row
    per task when it is shuffled, and the join reuses that partitioning.
    """
    named = child.groupBy(child_key).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_key).alias("_key"))
    return named.join(known, F.col(child_key) == F.col("_key"), "left_anti")


def duplicate_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def _reference_report(tables: Mapping[str, DataFrame], ref: Reference) -> DataFrame:
    child = tables[ref.child].select(ref.column)
    if ref.nullable:
        child = child.where(F.col(ref.column).isNotNull())
    missing = orphan_keys(child, tables[ref.parent], ref.column, ref.parent_column)
    return missing.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")).select(
        F.lit(ref.child).alias("table"), F.lit(ref.column).alias("column"),
        F.lit(ref.parent).alias("references"), "violations")


def reference_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that break each declared reference."""
    reports = [_reference_report(tables, r) for r in REFERENCES
               if r.child in tables and r.parent in tables]
    return reduce(DataFrame.unionByName, reports)


def key_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of repeated key values in each table that declares a key."""
    reports = [
        duplicate_keys(tables[name], *key).agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit(name).alias("table"), F.lit(",".join(key)).alias("key"), "violations")
        for name, key in PRIMARY_KEYS.items() if name in tables]
    return reduce(DataFrame.unionByName, reports)


def missing_from(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Keys of ``part`` that ``whole`` lacks; empty when ``part`` is a subset."""
    return orphan_keys(part, whole, key, key).select(key)
