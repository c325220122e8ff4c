"""Writers for triple sets: N-Triples, Turtle, N3 and RDF/XML."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.operators.triples import (
    COMMENT, LABEL, OWL, RANGE, RDF, RDF_TYPE, RDFS, SEE_ALSO, SUBCLASS, VERSION, XSD, Vocabulary,
    escaped, triple_lines)

GROUPED_FORMATS = ("turtle", "n3")

# Objects after which a statement ends and its subject begins anew, so that no statement grows without bound.
_STATEMENT = 1000
_LOCAL = "[A-Za-z_][A-Za-z0-9_]*"


def write_triples(triples: DataFrame, path: str, fmt: str = "xml",
                  words: Vocabulary = Vocabulary()) -> None:
    """Write a folder of files, each a valid document in the given format.

    A triple set has no order and every triple is a statement of its own: as XML and N-Triples each task
    writes the triples it holds. Turtle and N3 group them by subject and predicate, below the prefixes.
    """
    if fmt == "xml":
        _write_xml(triples, path, words)
    elif fmt == "nt":
        triple_lines(triples).write.mode("overwrite").text(path)
    elif fmt in GROUPED_FORMATS:
        _write_grouped(triples, path, words)
    else:
        raise ValueError(f"unknown triple format: {fmt}")


def _element(predicate: str, tag: str) -> Column:
    """The XML element of one predicate; NULL, hence absent, for other triples."""
    here = F.col("predicate") == predicate
    element = F.struct(
        F.when(F.col("object_kind") == "iri", F.col("object")).alias("_rdf:resource"),
        F.col("datatype").alias("_rdf:datatype"),
        F.when(F.col("object_kind") == "literal", F.col("object")).alias("_VALUE"))
    return F.when(here, element).alias(tag)


def _tags(words: Vocabulary) -> dict[str, str]:
    tags = {RDF_TYPE: "rdf:type", LABEL: "rdfs:label", COMMENT: "rdfs:comment",
            SUBCLASS: "rdfs:subClassOf", RANGE: "rdfs:range", SEE_ALSO: "rdfs:seeAlso",
            VERSION: "owl:versionInfo"}
    return tags | {words.term(name): f"{words.prefix}:{name}" for name, _, _ in words.properties}


def _write_xml(triples: DataFrame, path: str, words: Vocabulary) -> None:
    """A predicate without an element name is an error: nothing is left out."""
    tags = _tags(words)
    spaces = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, words.prefix: words.base}
    declared = " ".join(f'xmlns:{k}="{v}"' for k, v in spaces.items())
    unknown = F.raise_error(F.concat(F.lit("no XML element for predicate "), F.col("predicate")))
    subject = F.when(F.col("predicate").isin(list(tags)), F.col("subject")).otherwise(unknown.cast("string"))
    described = triples.select(subject.alias("_rdf:about"),
                               *[_element(p, tag) for p, tag in tags.items()])
    (described.write.mode("overwrite").format("xml")
     .option("rootTag", f"rdf:RDF {declared}").option("rowTag", "rdf:Description")
     .option("validateName", False).save(path))


def read_xml(spark: SparkSession, path: str, words: Vocabulary = Vocabulary()) -> DataFrame:
    """The statements of a folder that ``write_triples`` wrote as XML."""
    tags = _tags(words)
    element = "struct<`_rdf:resource`: string, `_rdf:datatype`: string, _VALUE: string>"
    schema = "`_rdf:about` string, " + ", ".join(f"`{tag}` {element}" for tag in tags.values())
    rows = spark.read.format("xml").option("rowTag", "rdf:Description").schema(schema).load(path)

    def statement(predicate: str, tag: str) -> Column:
        e = F.col(f"`{tag}`")
        iri = e["_rdf:resource"]
        return F.when(e.isNotNull(), F.struct(
            F.lit(predicate).alias("predicate"), F.coalesce(iri, e["_VALUE"]).alias("object"),
            F.when(iri.isNotNull(), "iri").otherwise("literal").alias("object_kind"),
            e["_rdf:datatype"].alias("datatype")))

    found = rows.select(F.col("`_rdf:about`").alias("subject"),
                        F.explode(F.array(*[statement(p, tag) for p, tag in tags.items()])).alias("s"))
    return found.where("s is not null").select("subject", "s.*")


def _spaces(words: Vocabulary) -> dict[str, str]:
    """Prefixes of the Turtle and N3 files. A dataset name that cannot be a prefix gets a neutral one."""
    fixed = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}
    own = words.prefix if re.fullmatch("[a-z][a-z0-9]*", words.prefix) and words.prefix not in fixed else "ns"
    return fixed | {own: words.base}


def _iri(column: str, spaces: dict[str, str]) -> Column:
    """An IRI as a prefixed name where one of the namespaces leaves a plain local name, else in full."""
    iri = F.col(column)
    name = F.concat(F.lit("<"), iri, F.lit(">"))
    for prefix, base in sorted(spaces.items(), key=lambda item: len(item[1])):
        rest = F.substring(iri, F.lit(len(base) + 1), F.length(iri))
        name = F.when(iri.startswith(base) & rest.rlike(f"^{_LOCAL}$"),
                      F.concat(F.lit(f"{prefix}:"), rest)).otherwise(name)
    return name


def _write_grouped(triples: DataFrame, path: str, words: Vocabulary) -> None:
    """Triples are sorted in ranges, one file each; a subject with very many is divided among files."""
    spaces = _spaces(words)
    header = [f"@prefix {prefix}: <{base}> ." for prefix, base in spaces.items()]
    literal = F.concat(F.lit('"'), escaped(F.col("object")), F.lit('"'))
    value = (F.when(F.col("object_kind") == "iri", _iri("object", spaces))
             .when(F.col("datatype").isNotNull(), F.concat(literal, F.lit("^^"), _iri("datatype", spaces)))
             .otherwise(literal))
    named = triples.select(
        _iri("subject", spaces).alias("s"),
        F.when(F.col("predicate") == RDF_TYPE, "a").otherwise(_iri("predicate", spaces)).alias("p"),
        value.alias("o"))

    def statements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One line for each subject and object; how a line ends shows once the next triple is known."""
        subject = predicate = line = None
        objects = 0
        for batch in batches:
            lines = []
            for s, p, o in zip(*(c.to_pylist() for c in batch.columns)):
                if s != subject or objects == _STATEMENT:
                    lines += header if line is None else [f"{line} ."]
                    lines.append(s)
                    line, objects = f"    {p} {o}", 0
                elif p != predicate:
                    lines.append(f"{line} ;")
                    line = f"    {p} {o}"
                else:
                    lines.append(f"{line} ,")
                    line = f"        {o}"
                subject, predicate = s, p
                objects += 1
            yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
        if line is not None:
            yield pa.record_batch([pa.array([f"{line} ."])], ["value"])

    (named.repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o")
     .mapInArrow(statements, "value string").write.mode("overwrite").text(path))


def _whole_iri(name: Column, spaces: dict[str, str]) -> Column:
    """The IRI a name of a Turtle file stands for."""
    bases = F.create_map(*[F.lit(x) for item in spaces.items() for x in item])
    base = F.try_element_at(bases, F.substring_index(name, ":", 1))
    prefixed = F.concat(base, F.substring(name, F.instr(name, ":") + 1, F.length(name)))
    return (F.when(name == "a", RDF_TYPE)
            .when(name.startswith("<"), F.substring(name, F.lit(2), F.length(name) - 2))
            .otherwise(F.coalesce(prefixed, F.raise_error(F.concat(F.lit("unknown name "), name)).cast("string"))))


def _plain_text(text: Column) -> Column:
    """Undo ``escaped``: what stands between two double backslashes holds the other escapes only."""
    def part(piece: Column) -> Column:
        for code, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
            piece = F.replace(piece, F.lit(code), F.lit(plain))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def read_grouped(spark: SparkSession, path: str, words: Vocabulary = Vocabulary()) -> DataFrame:
    """The triples of a folder that ``write_triples`` wrote as Turtle or N3.

    Files are read by statement: its end cannot stand inside a literal, whose line breaks are escaped.
    """
    spaces = _spaces(words)
    found = spark.read.option("lineSep", " .\n").text(path).where(~F.col("value").startswith("@prefix"))
    halves = F.split("value", "\n    ", 2)
    groups = found.select(halves[0].alias("s"), F.explode(F.split(halves[1], " ;\n    ")).alias("g"))
    space = F.instr("g", " ")
    objects = F.split(F.substring(F.col("g"), space + 1, F.length("g")), " ,\n        ")
    rows = groups.select("s", F.substring_index("g", " ", 1).alias("p"), F.explode(objects).alias("o"))
    literal = F.col("o").startswith('"')
    form = r'(?s)^"(.*)"(?:\^\^(.+))?$'
    kind = F.nullif(F.regexp_extract("o", form, 2), F.lit(""))
    return rows.select(
        _whole_iri(F.col("s"), spaces).alias("subject"), _whole_iri(F.col("p"), spaces).alias("predicate"),
        F.when(literal, _plain_text(F.regexp_extract("o", form, 1))).otherwise(
            _whole_iri(F.col("o"), spaces)).alias("object"),
        F.when(literal, "literal").otherwise("iri").alias("object_kind"),
        F.when(literal & kind.isNotNull(), _whole_iri(kind, spaces)).alias("datatype"))
