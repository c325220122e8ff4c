"""A category taxonomy as a set of triples.

A triple is a row ``(subject, predicate, object, object_kind, datatype)``:
``object_kind`` is ``iri`` or ``literal`` and ``datatype`` is set for typed
literals only. Sets of triples are distinct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.functions.scalars import local_name, term_uri
from annoweave.session import settle

# Public W3C namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

RDF_TYPE = f"{RDF}type"
LABEL = f"{RDFS}label"
COMMENT = f"{RDFS}comment"
SUBCLASS = f"{RDFS}subClassOf"
RANGE = f"{RDFS}range"
SEE_ALSO = f"{RDFS}seeAlso"
VERSION = f"{OWL}versionInfo"
CLASS = f"{OWL}Class"
ONTOLOGY = f"{OWL}Ontology"
DATATYPE_PROPERTY = f"{OWL}DatatypeProperty"
OBJECT_PROPERTY = f"{OWL}ObjectProperty"
INTEGER = f"{XSD}integer"
TEXT = f"{XSD}string"

TRIPLE_COLUMNS = ("subject", "predicate", "object", "object_kind", "datatype")


@dataclass(frozen=True)
class Vocabulary:
    """Names and texts of the ontology; give the dataset's own to describe that dataset."""

    base: str = "http://example.org/ontology/"
    dataset: str = "Dataset"
    see_also: str = "http://example.org/dataset"
    # The texts and local names of the taxonomy's terms.
    version: str = "1.0"
    title: str = "{dataset} Ontology"
    header_name: str = "{dataset}Ontology"
    header_comment: str = "Ontology for {dataset} clothing taxonomy"
    root_name: str = "ClothingItem"
    root_label: str = "Clothing Item"
    root_comment: str = "Base class for all clothing items"
    group_comment: tuple[str, str] = ("Supercategory for ", " clothing items")
    category_comment: str = "Clothing category: "
    properties: tuple[tuple[str, str, str], ...] = (
        ("hasCategoryId", "has category ID", INTEGER),
        ("hasTaxonomyId", "has taxonomy ID", TEXT),
        ("hasLevel", "has level", INTEGER),
    )

    def term(self, name: str) -> str:
        return self.base + name

    def text(self, template: str) -> str:
        return template.format(dataset=self.dataset)

    @property
    def prefix(self) -> str:
        return self.dataset.lower()


def _fixed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Literal triples, as one row that unfolds on the JVM side."""
    facts = [F.struct(*[F.lit(value).cast("string").alias(name)
                        for name, value in zip(TRIPLE_COLUMNS, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*facts)))


def header_triples(spark: SparkSession, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Type, label, comment, version and link of the ontology itself."""
    about = words.term(words.text(words.header_name))
    return _fixed(spark, [
        (about, RDF_TYPE, ONTOLOGY, "iri", None),
        (about, LABEL, words.text(words.title), "literal", None),
        (about, COMMENT, words.text(words.header_comment), "literal", None),
        (about, VERSION, words.version, "literal", None),
        (about, SEE_ALSO, words.see_also, "literal", None)])


def property_triples(spark: SparkSession, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Type, label and range of each datatype property."""
    rows = []
    for name, label, kind in words.properties:
        rows += [(words.term(name), RDF_TYPE, DATATYPE_PROPERTY, "iri", None),
                 (words.term(name), LABEL, label, "literal", None),
                 (words.term(name), RANGE, kind, "iri", None)]
    return _fixed(spark, rows)


def root_triples(spark: SparkSession, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Type, label and comment of the root class."""
    root = words.term(words.root_name)
    return _fixed(spark, [
        (root, RDF_TYPE, CLASS, "iri", None),
        (root, LABEL, words.root_label, "literal", None),
        (root, COMMENT, words.root_comment, "literal", None)])


def _triple(predicate: str, value: Column, kind: str = "literal",
            datatype: str | None = None) -> Column:
    return F.struct(F.lit(predicate).alias("predicate"), value.cast("string").alias("object"),
                    F.lit(kind).alias("object_kind"),
                    F.lit(datatype).cast("string").alias("datatype"))


def _expand(df: DataFrame, subject: Column, facts: list[Column]) -> DataFrame:
    return df.select(subject.alias("subject"), F.inline(F.array(*facts)))


def supercategories(categories: DataFrame) -> DataFrame:
    return categories.select("supercategory").distinct()


def group_triples(categories: DataFrame, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Type, label, comment and parent of each distinct supercategory."""
    name = F.col("supercategory")
    before, after = words.group_comment
    return _expand(supercategories(categories), term_uri(words.base, name, "supercategory"), [
        _triple(RDF_TYPE, F.lit(CLASS), "iri"),
        _triple(LABEL, name),
        _triple(COMMENT, F.concat(F.lit(before), name, F.lit(after))),
        _triple(SUBCLASS, F.lit(words.term(words.root_name)), "iri")])


def category_triples(categories: DataFrame, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Type, label, comment, parent, id, taxonomy id and level of each category."""
    name = F.col("name")
    ids, taxonomy_ids, levels = (words.term(p[0]) for p in words.properties)
    return _expand(categories, term_uri(words.base, name, "category"), [
        _triple(RDF_TYPE, F.lit(CLASS), "iri"),
        _triple(LABEL, name),
        _triple(COMMENT, F.concat(F.lit(words.category_comment), name)),
        _triple(SUBCLASS, term_uri(words.base, "supercategory", "supercategory"), "iri"),
        _triple(ids, F.col("id"), datatype=INTEGER),
        _triple(taxonomy_ids, F.col("taxonomy_id")),
        _triple(levels, F.col("level"), datatype=INTEGER)])


def ontology(categories: DataFrame, words: Vocabulary = Vocabulary()) -> DataFrame:
    """The whole triple set; categories with the same cleaned name share a subject."""
    spark = categories.sparkSession
    parts = [header_triples(spark, words), property_triples(spark, words),
             root_triples(spark, words), group_triples(categories, words),
             category_triples(categories, words)]
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def triple_summary(triples: DataFrame) -> DataFrame:
    """One row: triples, classes, object properties and datatype properties."""
    typed = F.col("predicate") == RDF_TYPE
    return triples.agg(
        F.count(F.lit(1)).alias("triples"),
        F.count_if(typed & (F.col("object") == CLASS)).alias("classes"),
        F.count_if(typed & (F.col("object") == OBJECT_PROPERTY)).alias("object_properties"),
        F.count_if(typed & (F.col("object") == DATATYPE_PROPERTY)).alias("data_properties"))


def example_classes(triples: DataFrame, limit: int = 5) -> DataFrame:
    """The first classes by URI, and how many more there are."""
    # Settled, so that the triple set is built once for the rows and the count.
    classes = settle(triples.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == CLASS))
                     .select(local_name("subject").alias("class"), "subject"))
    more = classes.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
    first = classes.orderBy("subject").limit(limit).select("class", F.lit(None).cast("bigint").alias("more"))
    return first.unionByName(more.select(F.lit("... and more").alias("class"), "more"))


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def triple_lines(triples: DataFrame) -> DataFrame:
    """One line per triple in N-Triples syntax."""
    literal = F.concat(F.lit('"'), escaped(F.col("object")), F.lit('"'))
    typed = F.concat(literal, F.lit("^^<"), F.col("datatype"), F.lit(">"))
    value = (F.when(F.col("object_kind") == "iri", F.concat(F.lit("<"), F.col("object"), F.lit(">")))
              .when(F.col("datatype").isNotNull(), typed).otherwise(literal))
    return triples.select(F.concat(
        F.lit("<"), F.col("subject"), F.lit("> <"), F.col("predicate"), F.lit("> "),
        value, F.lit(" .")).alias("value"))
