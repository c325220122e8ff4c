"""Readers for nested annotation documents.

A document holds ``info`` and the arrays ``licenses``, ``categories``,
``attributes``, ``images`` and ``annotations``. Each member is read with a schema
that names it alone, so the parser skips the rest of the text. Every row carries
``_order``, its position in the input, which defines "first appearance".

Nothing is lost on reading: rows with a value that does not convert to its type, and documents and
lines that are not valid JSON, are kept apart in ``Raw``.

Here one document is one record: no parallelism inside a file. ``chunks`` reads large
documents in byte ranges, and JSON lines of one member are split as well.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoweave.functions.scalars import whole_number
from annoweave.schemas import MEMBER_TYPES, MEMBERS, element_schema, member_schema
from annoweave.session import path_exists

CORRUPT = "_corrupt_record"
#: Reader options for files that are one JSON value each. Control characters end no line of valid JSON, so a file
#: is one line. ``multiLine`` reads the same rows, but fetches every number that is kept as text from the file anew.
WHOLE_FILES = {"lineSep": "\x1e\x1e\x1e"}


class Raw(dict):
    """The rows of each member with their types, and what could not be read.

    ``unconverted`` has the rows with a value of the wrong kind (member, fields, row), ``damaged``
    the documents or lines that are not JSON of the expected form (source, text).
    """

    def __init__(self, members: dict[str, DataFrame], damaged: DataFrame):
        split = {name: typed(df, name) for name, df in members.items()}
        super().__init__({name: good for name, (good, _) in split.items()})
        self.unconverted = reduce(DataFrame.unionByName, [bad for _, bad in split.values()])
        self.damaged = damaged


def typed(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows as read from text to rows with the member's types, and those that do not convert."""
    converted = {c: F.col(c).try_cast("double") if kind == "double" else whole_number(c, kind)
                 for c, kind in MEMBER_TYPES[name].items()}
    lost = [F.when(F.col(c).isNotNull() & value.isNull(), F.lit(c)) for c, value in converted.items()]
    odd = F.coalesce(*lost).isNotNull()
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    good = rows.where(~odd).select([converted[c].alias(c) if c in converted else F.col(c) for c in rows.columns])
    bad = rows.where(odd).select(F.lit(name).alias("member"), F.concat_ws(",", *lost).alias("fields"),
                                 F.to_json(F.struct(*plain)).alias("row"))
    return good, bad


def _unfold(docs: DataFrame, name: str, doc_key: str) -> DataFrame:
    """One row per element of member ``name``; a missing member gives no rows."""
    if name == "info":
        return docs.where("info is not null").select(F.struct(doc_key).alias("_order"), "info.*")
    # The outer form leaves out the size test that would parse a document twice.
    return (docs.select(doc_key, F.posexplode_outer(name).alias("_pos", "_item"))
                .where("_pos is not null")
                .select(F.struct(doc_key, "_pos").alias("_order"), "_item.*"))


def _checked_schema(*names: str) -> T.StructType:
    return member_schema(*names).add(CORRUPT, "string")


def read_documents(spark: SparkSession, path: str | list[str],
                   stage: Callable[[str, DataFrame], DataFrame] | None = None) -> Raw:
    """All members of the JSON documents at ``path``; a missing path raises.

    Without ``stage`` every use of a member parses the text again, skipping the
    other members. With it the documents are parsed once, and stored by ``stage``
    with one column per member, of which later reads take only the one they need.
    """
    def parsed(*names: str) -> DataFrame:
        return (spark.read.schema(_checked_schema(*names)).options(**WHOLE_FILES)
                .option("columnNameOfCorruptRecord", CORRUPT).json(path)
                .select(F.col("_metadata.file_path").alias("_file"), *names, CORRUPT))
    docs = stage("documents", parsed(*MEMBERS)) if stage else None

    def member(name: str) -> DataFrame:
        return (docs if docs is not None else parsed(name)).select("_file", name)

    whole = docs if docs is not None else parsed(*MEMBERS)
    damaged = whole.where(_is_damaged("info.year")).select(
        F.col("_file").alias("source"), F.col(CORRUPT).alias("text"))
    return Raw({name: _unfold(member(name), name, "_file") for name in MEMBERS}, damaged)


def documents_from_text(docs: DataFrame, text: str, doc_key: str, member: str | None = None) -> Raw:
    """The same members from a column of JSON text, one document per row.

    A text that does not spell a member's name, plainly or by escapes, is not parsed for it. A column
    ``member`` may name the only member a document has, which lets others skip its source.
    """
    members, broken = {}, []
    for name in MEMBERS:
        own = docs.where(F.col(member) == name) if member else docs
        spelled = F.contains(F.col(text), F.lit(f'"{name}"')) | F.contains(F.col(text), F.lit("\\u"))
        schema = _checked_schema(name).simpleString()
        parsed = own.select(doc_key, text, F.when(spelled, F.from_json(
            text, schema, {"columnNameOfCorruptRecord": CORRUPT})).alias("_doc"))
        members[name] = _unfold(parsed.select(doc_key, f"_doc.{name}"), name, doc_key)
        broken.append(parsed.where(F.col(f"_doc.{CORRUPT}").isNotNull())
                      .select(F.col(doc_key).alias("source"), F.col(text).alias("text")))
    return Raw(members, reduce(DataFrame.unionByName, broken).distinct())


def _is_damaged(other: str) -> Column:
    """Whether the parser kept the text as damaged; a scan that asks for nothing else is refused."""
    return F.coalesce(F.col(CORRUPT), F.col(other)) == F.col(CORRUPT)


def _lines(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    lines = (spark.read.schema(element_schema(name).add(CORRUPT, "string"))
             .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    order = F.struct(F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_line"))
    return lines.select(order.alias("_order"), "*")


def _damaged_lines(lines: DataFrame, name: str) -> DataFrame:
    return lines.where(_is_damaged(element_schema(name).names[0])).select(
        F.col("_order._file").alias("source"), F.col(CORRUPT).alias("text"))


def read_member_lines(spark: SparkSession, name: str, path: str | list[str]) -> Raw:
    """One member from JSON lines. Blank lines are skipped; large files are split."""
    lines = _lines(spark, name, path)
    return Raw({name: lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT)}, _damaged_lines(lines, name))


def read_member_files(spark: SparkSession, folder: str) -> Raw:
    """All members from ``<member>.jsonl`` below ``folder``; an absent member is empty."""
    members, broken = {}, [spark.createDataFrame([], "source string, text string")]
    for name in MEMBERS:
        path = f"{folder.rstrip('/')}/{name}.jsonl"
        if path_exists(spark, path):
            lines = _lines(spark, name, path)
            members[name] = lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            broken.append(_damaged_lines(lines, name))
        else:
            members[name] = spark.createDataFrame([], element_schema(name)).select(
                F.struct(F.lit(0).alias("_line")).alias("_order"), "*")
    return Raw(members, reduce(DataFrame.unionByName, broken))
