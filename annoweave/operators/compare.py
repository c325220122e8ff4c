"""Side-by-side reports on a full dataset and its sample."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.functions.scalars import percent_change, ratio
from annoweave.operators.reports import relationship_density, segmentation_coverage, table_counts
from annoweave.schemas import TABLES


def _side_by_side(full: DataFrame, sample: DataFrame, label: str, value: str) -> DataFrame:
    """Bring the values of both sides together by label, without a join."""
    both = (full.select(label, F.col(value).alias("full"), F.lit(None).cast("bigint").alias("sample"))
            .unionByName(sample.select(label, F.lit(None).cast("bigint").alias("full"),
                                       F.col(value).alias("sample"))))
    return both.groupBy(label).agg(F.coalesce(F.max("full"), F.lit(0)).alias("full"),
                                   F.coalesce(F.max("sample"), F.lit(0)).alias("sample"))


def compare_counts(full: Mapping[str, DataFrame], sample: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table on both sides and their ratio; an absent table counts as zero."""
    counts = _side_by_side(table_counts(full), table_counts(sample), "table", "rows")
    return counts.select("*", ratio("sample", "full").alias("ratio"))


def _unpivot(row: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
             for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def _compare_metrics(full: DataFrame, sample: DataFrame) -> DataFrame:
    both = (_unpivot(full).select("metric", F.col("value").alias("full"),
                                  F.lit(None).cast("double").alias("sample"))
            .unionByName(_unpivot(sample).select("metric", F.lit(None).cast("double").alias("full"),
                                                 F.col("value").alias("sample"))))
    return (both.groupBy("metric").agg(F.max("full").alias("full"), F.max("sample").alias("sample"))
                .select("*", ratio("sample", "full").alias("ratio")))


def compare_density(full: Mapping[str, DataFrame], sample: Mapping[str, DataFrame]) -> DataFrame:
    """Images, annotations and annotations per image on both sides."""
    return _compare_metrics(*(relationship_density(t["images"], t["annotations"])
                              for t in (full, sample)))


def compare_coverage(full: Mapping[str, DataFrame], sample: Mapping[str, DataFrame]) -> DataFrame:
    """Annotations with points and point totals on both sides."""
    return _compare_metrics(*(segmentation_coverage(t["annotations"], t["segmentations"])
                              for t in (full, sample)))


def compare_columns(spark: SparkSession, full: Mapping[str, DataFrame],
                    sample: Mapping[str, DataFrame]) -> DataFrame:
    """Column lists and column counts of each table; reads schemas only."""
    def listed(tables: Mapping[str, DataFrame], name: str) -> list[str]:
        return tables[name].columns if name in tables else []
    names = [n for n in TABLES if n in full or n in sample]
    rows = [(n, len(listed(full, n)), len(listed(sample, n)),
             ", ".join(listed(full, n)), ", ".join(listed(sample, n)),
             None if n in full and n in sample else "table not found") for n in names]
    return spark.createDataFrame(
        rows, "table string, full_columns int, sample_columns int, full_list string, "
              "sample_list string, error string")


def compare_previews(full: DataFrame, sample: DataFrame, *key: str, rows: int = 3) -> DataFrame:
    """The first rows of both sides by key, marked by side."""
    def first(df: DataFrame, side: str) -> DataFrame:
        return df.orderBy(*key).limit(rows).select(F.lit(side).alias("side"), "*")
    return first(full, "full").unionByName(first(sample, "sample"))


def compare_methods(metrics: DataFrame, method: str, base: str, other: str,
                    *measures: str) -> DataFrame:
    """Percentage difference of each measure between two methods, one row per measure."""
    def value(name: str, measure: str):
        return F.max(F.when(F.col(method) == name, F.col(measure).cast("double")))
    sides = [F.struct(F.lit(m).alias("measure"), value(base, m).alias("base"),
                      value(other, m).alias("other")) for m in measures]
    return (metrics.agg(F.array(*sides).alias("_sides")).select(F.inline("_sides"))
                   .select("*", percent_change("base", "other").alias("percent_change")))
