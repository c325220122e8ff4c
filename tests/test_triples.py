import glob
import json
from xml.etree import ElementTree

import pytest

from annoweave.functions.scalars import clean_name, local_name
from annoweave.operators import triples
from annoweave.plans.ontology import generate_from_file, left_out
from annoweave.sinks import triples as sink
from annoweave.sinks.triples import read_grouped, read_xml, write_triples
from annoweave.sources.taxonomy import incomplete_categories, read_categories
from conftest import taxon
from pyspark.sql import functions as F

SAMPLE = [taxon(4, "tug, push-boat", "working boats", 3, "t-04"),
          taxon(5, "ferry - car_ferry", "working boats", 3, "t-05"),
          taxon(8, "buoy", "marks", 4, "m-08")]
WORDS = triples.Vocabulary(base="http://example.com/o/", dataset="Wardrobe", see_also="http://example.com/w")


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(
        [(c["id"], c["name"], c["supercategory"], c["level"], c["taxonomy_id"]) for c in SAMPLE],
        "id long, name string, supercategory string, level int, taxonomy_id string")


def test_clean_name(spark):
    cases = {"tug, push-boat": "tug_push_boat", "Ferry - car_ferry": "ferry_car_ferry", "buoy": "buoy",
             " -A,,b__c- ": "a_b_c", "x/y (z)": "x/y_(z)", "": "", "---": ""}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r.name: r.c for r in df.select("name", clean_name("name").alias("c")).collect()} == cases


def test_local_name(spark):
    df = spark.createDataFrame([("http://a/b#c",), ("http://a/b",)], "u string")
    assert [r[0] for r in df.select(local_name("u")).collect()] == ["c", "http://a/b"]


def test_golden_counts(spark, sample):
    found = triples.ontology(sample, WORDS)
    assert found.count() == 17 + 4 * 2 + 7 * 3 == 46
    assert triples.triple_summary(found).first().asDict() == {
        "triples": 46, "classes": 6, "object_properties": 0, "data_properties": 3}


def test_statements_of_a_category(spark, sample):
    found = {(r.predicate, r.object, r.object_kind, r.datatype)
             for r in triples.ontology(sample, WORDS).collect()
             if r.subject == "http://example.com/o/category_tug_push_boat"}
    assert found == {
        (triples.RDF_TYPE, triples.CLASS, "iri", None),
        (triples.LABEL, "tug, push-boat", "literal", None),
        (triples.COMMENT, "Clothing category: tug, push-boat", "literal", None),
        (triples.SUBCLASS, "http://example.com/o/supercategory_working_boats", "iri", None),
        ("http://example.com/o/hasCategoryId", "4", "literal", triples.INTEGER),
        ("http://example.com/o/hasTaxonomyId", "t-04", "literal", None),
        ("http://example.com/o/hasLevel", "3", "literal", triples.INTEGER)}


def test_header_follows_the_vocabulary(spark):
    found = {(r.subject, r.object) for r in triples.header_triples(spark, WORDS).collect()}
    about = "http://example.com/o/WardrobeOntology"
    assert found == {(about, o) for o in (
        triples.ONTOLOGY, "Wardrobe Ontology", "Ontology for Wardrobe clothing taxonomy", "1.0",
        "http://example.com/w")}


def test_same_cleaned_name_shares_a_subject(spark):
    twins = spark.createDataFrame([(1, "a b", "g", 1, "x"), (2, "a-b", "g", 1, "x")],
                                  "id long, name string, supercategory string, level int, taxonomy_id string")
    found = triples.ontology(twins, WORDS)
    subject = "http://example.com/o/category_a_b"
    # type, parent, taxonomy id and level coincide; label, comment and id do not
    assert found.where(found.subject == subject).count() == 4 + 2 * 3


def test_example_classes(spark, sample):
    shown = triples.example_classes(triples.ontology(sample, WORDS), 4).collect()
    assert [r.more for r in shown] == [None] * 4 + [2]


def _statements(path):
    about = "{" + triples.RDF + "}about"
    for name in glob.glob(f"{path}/part-*"):
        text = open(name).read()
        if text.strip():
            for node in ElementTree.fromstring(text):
                for fact in node:
                    yield (node.attrib[about], fact.tag,
                           fact.attrib.get("{" + triples.RDF + "}resource"),
                           fact.attrib.get("{" + triples.RDF + "}datatype"), fact.text)


def test_xml_files_hold_every_statement(spark, sample, tmp_path):
    found = triples.ontology(sample, WORDS)
    write_triples(found, str(tmp_path / "x"), "xml", WORDS)
    written = sorted(_statements(tmp_path / "x"), key=repr)
    split = {p: p for p in ()}
    def tag(p):
        base = next(b for b in (triples.RDF, triples.RDFS, triples.OWL, WORDS.base) if p.startswith(b))
        return "{" + base + "}" + p[len(base):]
    want = sorted(((r.subject, tag(r.predicate), r.object if r.object_kind == "iri" else None, r.datatype,
                    r.object if r.object_kind == "literal" else None) for r in found.collect()), key=repr)
    assert written == want


def test_lines_escape_literals(spark):
    df = spark.createDataFrame([("s", "p", 'a "b"\\\n\r\tc', "literal", None), ("s", "p", "o", "iri", None),
                                ("s", "p", "5", "literal", triples.INTEGER)],
                               "subject string, predicate string, object string, object_kind string, datatype string")
    assert [r.value for r in triples.triple_lines(df).collect()] == [
        '<s> <p> "a \\"b\\"\\\\\\n\\r\\tc" .', "<s> <p> <o> .",
        f'<s> <p> "5"^^<{triples.INTEGER}> .']


@pytest.mark.parametrize("fmt", ["xml", "nt", "turtle", "n3"])
@pytest.mark.parametrize("name", ["categories.jsonl", "categories.json"])
def test_from_file(spark, tmp_path, fmt, name):
    path = tmp_path / name
    if name.endswith("l"):
        path.write_text("\n\n".join(json.dumps(c) for c in SAMPLE) + "\n")
    else:
        path.write_text(json.dumps(SAMPLE, indent=1))
    found = generate_from_file(spark, str(path), str(tmp_path / "out"), fmt, WORDS)
    assert found.count() == 46
    if fmt == "nt":
        assert spark.read.text(str(tmp_path / "out")).count() == 46
    if fmt in ("turtle", "n3"):
        back = read_grouped(spark, str(tmp_path / "out"), WORDS)
        assert back.count() == 46 and back.exceptAll(found).isEmpty()


TRIPLES = "subject string, predicate string, object string, object_kind string, datatype string"
HARD = ["", " ", '"', "\\", "\\\\", '\\"', "\\n", "\\\n", "a .\nb", "a ;\n    b", "a ,\n        b", '"^^<x>', "x\"^^xsd:y",
        "@prefix", "\r\n\t", "<a>", "ex:b", "\u2028é\U0001f600"]


def test_turtle_groups_by_subject_below_prefixes(spark, tmp_path):
    base, path = WORDS.base, str(tmp_path / "t")
    rows = [(base + "A", triples.RDF_TYPE, triples.CLASS, "iri", None),
            (base + "A", triples.LABEL, "a", "literal", None), (base + "A", triples.LABEL, "b", "literal", None),
            (base + "A", base + "n", "5", "literal", triples.INTEGER),
            (base + "x/y", triples.SEE_ALSO, "http://else.org/#q", "iri", None)]
    write_triples(spark.createDataFrame(rows, TRIPLES).coalesce(1), path, "turtle", WORDS)
    texts = [open(n).read() for n in glob.glob(f"{path}/part-*")]
    texts = [t for t in texts if t]
    body = "".join("".join(t.partition("@prefix wardrobe: <http://example.com/o/> .\n")[2]) for t in texts)
    assert all(t.startswith(f"@prefix rdf: <{triples.RDF}> .\n") for t in texts)
    if len(texts) == 1:
        assert body == ("""<http://example.com/o/x/y>
    rdfs:seeAlso <http://else.org/#q> .
wardrobe:A
    a owl:Class ;
    rdfs:label "a" ,
        "b" ;
    wardrobe:n "5"^^xsd:integer .
""")


@pytest.mark.parametrize("most", [1000, 3])
@pytest.mark.parametrize("name", ["Wardrobe", "Two words", "owl"])
def test_turtle_is_read_back(spark, monkeypatch, tmp_path, rows, most, name):
    """Also literals that look like syntax, and a subject in several statements."""
    monkeypatch.setattr(sink, "_STATEMENT", most)
    words = triples.Vocabulary(base="http://example.com/o/", dataset=name)
    given = [(words.base + s, p, o, "literal", d) for s in ("A", "b-c", "") for o in HARD
             for p in (triples.LABEL, words.base + "p", triples.RDF_TYPE)
             for d in (None, triples.TEXT, "http://else.org/t")]
    given += [(words.base + "A", words.base + f"q{i % 7}", f"http://else.org/{i}", "iri", None) for i in range(50)]
    found = spark.createDataFrame(given, TRIPLES).repartition(4)
    write_triples(found, str(tmp_path / "t"), "turtle", words)
    assert rows(read_grouped(spark, str(tmp_path / "t"), words), *found.columns) == rows(found)


def test_no_triples(spark, tmp_path):
    write_triples(spark.createDataFrame([], TRIPLES), str(tmp_path / "t"), "n3", WORDS)
    assert read_grouped(spark, str(tmp_path / "t"), WORDS).isEmpty()


def test_unknown_format(spark, sample, tmp_path):
    with pytest.raises(ValueError):
        write_triples(triples.ontology(sample), str(tmp_path / "o"), "owl")


def test_unknown_predicates_are_refused(spark, sample, tmp_path):
    odd = triples.ontology(sample, WORDS).limit(1).withColumn("predicate", F.lit(triples.OWL + "equivalentClass"))
    with pytest.raises(Exception, match="equivalentClass"):
        write_triples(odd, str(tmp_path / "o"), "xml", WORDS)


def test_xml_is_read_back(spark, sample, tmp_path, rows):
    found = triples.ontology(sample, WORDS)
    write_triples(found, str(tmp_path / "x"), "xml", WORDS)
    assert rows(read_xml(spark, str(tmp_path / "x"), WORDS), *found.columns) == rows(found)


def test_unusable_categories_stop_or_are_told(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join([json.dumps(SAMPLE[0]), json.dumps({"id": 9, "name": "x"}), '{"id": 10, "na',
                               json.dumps({**SAMPLE[1], "level": "high"})]) + "\n")
    categories = read_categories(spark, str(path))
    assert [r.id for r in incomplete_categories(categories).collect()] == [9]
    assert sorted(r.reason for r in left_out(spark, str(path)).collect()) == [
        "incomplete", "unreadable", "unreadable"]
    with pytest.raises(ValueError):
        generate_from_file(spark, str(path), str(tmp_path / "out"), "nt", WORDS)
    found = generate_from_file(spark, str(path), str(tmp_path / "out"), "nt", WORDS, strict=False)
    assert found.count() == 17 + 4 + 7
