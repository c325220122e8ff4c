"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Every stage sees all rows its predecessor kept. All but the last return the columns of documents.
``ORACLE_SQL`` is None: the learned, seeded and tokenizing stages have no SQL form; tests compare
each stage with a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.llm import language, lines, mixing, queries, similar
from annoweave.llm.common import stored, table, text_batches
from annoweave.operators.joins import keep_matching, keep_unmatched
from annoweave.session import release

#: Shingles of so many words, and the percentage of them that near duplicates share.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: null texts and texts without letters.

    The language is told of the text alone, so the texts that cannot be told are stored, by their SHA-256,
    and no row is copied. Whole texts pass through Python, so batches are kept small.
    """
    known = docs.select("doc_id", "text", "lang").where(
        (language.fold() != language.HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = language.predict(docs.select("text", _digest().alias("_digest")), language.learn(known), ("_digest",))
    with text_batches(spark):
        untold = stored(found.where(F.col("lang_pred") == language.UNKNOWN).select("_digest"), "pipeline-untold")
    named = docs.where("text is not null").withColumn("_digest", _digest())
    return keep_unmatched(named, untold, "_digest", "_digest").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated lines and runs; documents of which nothing is left go."""
    done = lines.without_repeats(docs).where((F.col("text") != "") | (F.col("n_deleted") == 0))
    size = F.length("text").cast("long")
    return done.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def _content(docs: DataFrame, *more: Column) -> Column:
    """Sixty-four bits of all columns of a row, nulls told apart by their place."""
    return F.xxhash64(*more, *[F.col(c).isNull() for c in docs.columns], *docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of smallest doc_id, null last, of each group connected by near duplicates.

    Every row is compared by a key of its own, so rows without an id or with the id of another take
    part like all others. Rows equal to the kept one in every column, its id included, are the same
    document still; ``one_of_each`` takes one of them.
    """
    keyed = stored(docs.select(*docs.columns, F.monotonically_increasing_id().alias("_key"),
                               _content(docs).alias("_h1"), _content(docs, F.lit("row")).alias("_h2")),
                   "pipeline-keyed")
    groups = similar.join_similar(keyed.select(F.col("_key").alias("doc_id"), "text"),
                                  width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    groups = stored(groups.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")),
                    "pipeline-groups")
    several = groups.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_group")
    # Groups of one row need no look-up.
    members = stored(groups.join(several, "_group").join(
        keyed.select("_key", "doc_id", "_h1", "_h2"), "_key"), "pipeline-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "_h1", "_h2")).alias("_first")
    firsts = members.groupBy("_group").agg(first)
    same = ((F.col("_key") == F.col("_first._key"))
            | (F.col("doc_id").isNotNull() & (F.col("_h1") == F.col("_first._h1"))
               & (F.col("_h2") == F.col("_first._h2"))))
    gone = stored(members.join(firsts, "_group").where(~same).select("_key"), "pipeline-gone")
    release(groups, members)
    return keep_unmatched(keyed, gone, "_key", "_key").select(*docs.columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One of the rows that are equal in every column. Only rows that repeat are shuffled."""
    named = docs.withColumn("_content", _content(docs))
    often = stored(named.groupBy("_content").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                   .select("_content"), "pipeline-repeats")
    if often.isEmpty():
        return docs
    alone = keep_unmatched(named, often, "_content", "_content").select(*docs.columns)
    repeats = keep_matching(named, often, "_content", "_content").select(*docs.columns)
    return alone.unionByName(repeats.dropDuplicates())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, one row of each, as often as the mix takes them."""
    return mixing.mixed_rows(one_of_each(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix."""
    return queries.coded(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
