"""Category file in, triple files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.operators.triples import Vocabulary, ontology
from annoweave.sinks.triples import write_triples
from annoweave.sources.taxonomy import (
    complete_categories, incomplete_categories, read_categories, unreadable_categories)


def left_out(spark: SparkSession, path: str) -> DataFrame:
    """Categories no triples are made of: unreadable ones and those without a key they need."""
    incomplete = incomplete_categories(read_categories(spark, path))
    return (unreadable_categories(spark, path).select(F.lit("unreadable").alias("reason"), "row")
            .unionByName(incomplete.select(F.lit("incomplete").alias("reason"),
                                           F.to_json(F.struct("*")).alias("row"))))


def generate_from_file(spark: SparkSession, path: str, output: str, fmt: str = "xml",
                       words: Vocabulary = Vocabulary(), *, strict: bool = True) -> DataFrame:
    """Read categories, write their triples, and return the triples.

    A category that cannot be used is an error; without ``strict`` it is left out, and
    ``left_out`` tells which.
    """
    if strict and not (missing := left_out(spark, path)).isEmpty():
        raise ValueError(f"categories that cannot be used: {[r.row for r in missing.take(3)]}")
    triples = ontology(complete_categories(read_categories(spark, path)), words)
    write_triples(triples, output, fmt, words)
    return triples
