"""One registered query per operator, over the given tables in dataset roles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.functions.scalars import clean_name, local_name, percent_change, ratio, term_uri
from annoweave.operators import compare, integrity, reports, sampling, shred, triples
from annoweave.operators.joins import keep_matching
from annoweave.plans.load import CHECKED, load_documents, shred_members
from annoweave.schemas import TABLES
from annoweave.session import scratch_path, settle
from annoweave.sinks.tables import write_tables
from annoweave.sinks.triples import read_grouped, read_xml, write_triples
from annoweave.sinks.versions import publish
from annoweave.sources.chunks import read_large_documents
from annoweave.sources.documents import read_documents, read_member_lines
from annoweave.sources.tables import ids, preview, read_tables
from annoweave.sources.taxonomy import complete_categories, read_categories
from catalog import roles
from catalog.roles import given

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Sample sizes of the registered sampling queries.
IMAGES_KEPT = 203
CHILDREN_KEPT = 500
FEW_STRATA_KEPT = 3
MANY_STRATA_KEPT = 700
REPEATED_KEPT = 1003
WORDS = triples.Vocabulary()
# Documents of the large-document queries are read in ranges of this size.
RANGE_BYTES = 64 << 10


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- usage reports and statistics -------------------------------------------------------

@query
def top_categories(spark, sf):
    """The ten parts with the most line items."""
    usage = reports.usage_counts(roles.categories(spark, sf), given(spark, sf, "lineitem"),
                                 "id", "l_partkey")
    return reports.top_used(usage, "id").select("id", "name", "supercategory", "count")


@query
def top_attributes(spark, sf):
    """The ten suppliers with the most line items."""
    t = roles.tables(spark, sf)
    usage = reports.usage_counts(t["attributes"], t["annotation_attributes"], "id",
                                 "attribute_id", counted="annotation_id")
    return reports.top_used(usage, "id").select("id", "name", "supercategory", "count")


@query
def category_usage(spark, sf):
    t = roles.tables(spark, sf)
    return (reports.usage_counts(t["categories"], t["annotations"], "id", "category_id", counted="id")
            .select("id", "name", "supercategory", "count"))


@query
def attribute_usage(spark, sf):
    t = roles.tables(spark, sf)
    return (reports.usage_counts(t["attributes"], t["annotation_attributes"], "id", "attribute_id")
            .select("id", "name", "supercategory", "count"))


@query
def image_summary(spark, sf):
    return reports.image_summary(roles.tables(spark, sf)["images"])


@query
def table_counts(spark, sf):
    return reports.table_counts(roles.tables(spark, sf))


@query
def table_statistics(spark, sf):
    return reports.table_statistics(roles.tables(spark, sf))


@query
def relationship_density(spark, sf):
    t = roles.tables(spark, sf)
    return reports.relationship_density(t["images"], t["annotations"])


@query
def segmentation_coverage(spark, sf):
    t = roles.tables(spark, sf)
    return reports.segmentation_coverage(t["annotations"], t["segmentations"])


@query
def image_ids(spark, sf):
    return ids(roles.tables(spark, sf)["images"])


@query
def category_preview(spark, sf):
    return preview(roles.categories(spark, sf), "id")


# --- shredding ----------------------------------------------------------------------------

def _raw(spark, sf):
    return roles.documents(spark, sf)


def _usable(spark, sf):
    return shred.boxed(_raw(spark, sf)["annotations"])


def _kept(spark, sf):
    raw = _raw(spark, sf)
    return shred.kept_annotations(shred.boxed(raw["annotations"]), raw["images"], raw["categories"])


@query
def shred_info(spark, sf):
    return shred.info_table(_raw(spark, sf)["info"])


@query
def shred_licenses(spark, sf):
    return shred.licenses_table(_raw(spark, sf)["licenses"])


@query
def shred_licenses_raw(spark, sf):
    return shred.licenses_table(_raw(spark, sf)["licenses"], drop_zero=False)


@query
def shred_categories(spark, sf):
    return shred.categories_table(_raw(spark, sf)["categories"])


@query
def shred_attributes(spark, sf):
    return shred.attributes_table(_raw(spark, sf)["attributes"])


@query
def shred_images(spark, sf):
    return shred.images_table(_raw(spark, sf)["images"])


@query
def zero_license_count(spark, sf):
    return shred.zero_license_count(_raw(spark, sf)["images"])


@query
def shred_annotations(spark, sf):
    return shred.annotations_table(_raw(spark, sf)["annotations"])


@query
def rejected_boxes(spark, sf):
    return shred.rejected_boxes(_raw(spark, sf)["annotations"]).select("id")


@query
def shred_links(spark, sf):
    return shred.annotation_links(_usable(spark, sf), numbers_only=False)


@query
def shred_points_strict(spark, sf):
    return shred.polygon_points(_usable(spark, sf), strict=True)


@query
def shred_points_coerced(spark, sf):
    return shred.polygon_points(_usable(spark, sf), strict=False)


@query
def rejected_points(spark, sf):
    return shred.rejected_points(_usable(spark, sf), strict=True)


@query
def polygon_points(spark, sf):
    return shred.polygon_points(roles.polygons(spark, sf))


# --- integrity ------------------------------------------------------------------------------

@query
def kept_annotations(spark, sf):
    return shred.annotations_table(_kept(spark, sf))


@query
def kept_links(spark, sf):
    links = shred.annotation_links(_kept(spark, sf))
    return shred.known_links(links, _raw(spark, sf)["attributes"])


@query
def orphaned_annotations(spark, sf):
    raw = _raw(spark, sf)
    return shred.orphaned_annotations(shred.boxed(raw["annotations"]), raw["images"], raw["categories"])


@query
def orphaned_links(spark, sf):
    links = shred.annotation_links(_usable(spark, sf))
    return shred.orphaned_links(links, _raw(spark, sf)["attributes"])


@query
def kept_points(spark, sf):
    return shred.polygon_points(_kept(spark, sf))


@query
def orphan_annotations(spark, sf):
    t = roles.tables(spark, sf)
    return integrity.orphans(t["annotations"], t["categories"], "category_id").select("id", "category_id")


@query
def reference_audit(spark, sf):
    return integrity.reference_audit(roles.tables(spark, sf))


@query
def key_audit(spark, sf):
    return integrity.key_audit(roles.tables(spark, sf))


@query
def duplicate_keys(spark, sf):
    return integrity.duplicate_keys(given(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query
def missing_categories(spark, sf):
    t = roles.tables(spark, sf)
    used = t["annotations"].select(F.col("category_id").alias("id"))
    return integrity.missing_from(used, t["categories"], "id")


# --- sampling ---------------------------------------------------------------------------------

def _customers(spark, sf):
    return given(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")


def _orders(spark, sf):
    return given(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


def _sampled_customers(spark, sf):
    return sampling.stratified_sample(_customers(spark, sf), IMAGES_KEPT, stratum="c_mktsegment",
                                      row_id="c_custkey")


@query
def sampling_gate(spark, sf):
    return sampling.gate_report(_customers(spark, sf), _orders(spark, sf))


@query
def sample_quota(spark, sf):
    return sampling.stratum_quotas(_customers(spark, sf), IMAGES_KEPT, stratum="c_mktsegment",
                                   order="c_custkey")


@query
def stratified_sample(spark, sf):
    return _sampled_customers(spark, sf)


@query
def stratified_sample_few(spark, sf):
    """Fewer rows than strata: later strata get none."""
    return sampling.stratified_sample(_customers(spark, sf), FEW_STRATA_KEPT, stratum="c_mktsegment",
                                      row_id="c_custkey")


@query
def stratified_sample_many_strata(spark, sf):
    """Far more strata than rows to keep."""
    annotations = roles.tables(spark, sf)["annotations"].select("id", "category_id")
    return sampling.stratified_sample(annotations, MANY_STRATA_KEPT, stratum="category_id")


@query
def stratified_sample_null_stratum(spark, sf):
    """Missing licenses form a stratum of their own."""
    images = roles.tables(spark, sf)["images"].select("id", "license")
    return sampling.stratified_sample(images, IMAGES_KEPT, stratum="license")


@query
def direct_stratified_sample(spark, sf):
    return sampling.stratified_sample(_orders(spark, sf), CHILDREN_KEPT, stratum="o_orderpriority",
                                      row_id="o_orderkey")


@query
def uniform_sample(spark, sf):
    return sampling.uniform_sample(_customers(spark, sf), IMAGES_KEPT, row_id="c_custkey")


@query
def direct_uniform_sample(spark, sf):
    return sampling.uniform_sample(_orders(spark, sf), CHILDREN_KEPT, row_id="o_orderkey")


@query
def child_stratified_sample(spark, sf):
    parents = settle(_sampled_customers(spark, sf).select("c_custkey"))
    return sampling.sample_children(
        _orders(spark, sf), parents, CHILDREN_KEPT, parent_key="o_custkey", parent_id="c_custkey",
        row_id="o_orderkey", stratum="o_orderpriority", at_most_parents=IMAGES_KEPT)


@query
def child_uniform_sample(spark, sf):
    parents = settle(_sampled_customers(spark, sf).select("c_custkey"))
    return sampling.sample_children(
        _orders(spark, sf), parents, CHILDREN_KEPT, parent_key="o_custkey", parent_id="c_custkey",
        row_id="o_orderkey", at_most_parents=IMAGES_KEPT)


@query
def unsampled_rows(spark, sf):
    sample = sampling.uniform_sample(_customers(spark, sf), IMAGES_KEPT, row_id="c_custkey")
    return sampling.unsampled(_customers(spark, sf), sample, row_id="c_custkey",
                              at_most=IMAGES_KEPT)


TARGETS = sampling.Targets(IMAGES_KEPT, CHILDREN_KEPT)


def _with_sample(spark, sf, *wanted):
    """The roles and a sample of the wanted tables, which is stored once."""
    t = roles.tables(spark, sf)
    cut = sampling.sample_dataset(t, TARGETS, wanted=wanted)
    sample = {n: settle(df) if n not in ("info", "licenses", "categories", "attributes") else df
              for n, df in cut.items()}
    return t, sample


@query
def referential_sample(spark, sf):
    t = roles.tables(spark, sf)
    images, annotations = sampling.referential_sample(
        t["images"], t["annotations"], TARGETS)
    return (images.select(F.lit("images").alias("table"), "id")
            .unionByName(annotations.select(F.lit("annotations").alias("table"), "id")))


@query
def referential_sample_uniform(spark, sf):
    t = roles.tables(spark, sf)
    images, annotations = sampling.referential_sample(
        t["images"], t["annotations"], TARGETS,
        method="uniform")
    return (images.select(F.lit("images").alias("table"), "id")
            .unionByName(annotations.select(F.lit("annotations").alias("table"), "id")))


@query
def referential_sample_all_images(spark, sf):
    """Every image is kept and annotations are sampled directly."""
    t = roles.tables(spark, sf)
    images, annotations = sampling.referential_sample(
        t["images"], t["annotations"], TARGETS, method="uniform", all_images=True)
    return (images.select(F.lit("images").alias("table"), "id")
            .unionByName(annotations.select(F.lit("annotations").alias("table"), "id")))


@query
def uniform_sample_repeated_ids(spark, sf):
    """Line items drawn by their order, which many share: rows taken of each order."""
    lines = given(spark, sf, "lineitem")
    sample = sampling.uniform_sample(lines, REPEATED_KEPT, row_id="l_orderkey")
    return sample.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"))


@query
def stratified_sample_repeated_ids(spark, sf):
    """Samples of rows that share ids: rows taken, and how many of them the table does not hold."""
    lines = given(spark, sf, "lineitem")
    sample = sampling.stratified_sample(lines, REPEATED_KEPT, stratum="l_returnflag", row_id="l_orderkey")
    sample = settle(sample)
    foreign = sample.exceptAll(lines).agg(F.count(F.lit(1)).alias("foreign_rows"))
    return sample.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(foreign))


# --- taxonomy -----------------------------------------------------------------------------------

@query
def clean_names(spark, sf):
    names = roles.taxonomy(spark, sf)
    return names.select(
        "id", clean_name("name").alias("cleaned"), term_uri(WORDS.base, "name").alias("uri"),
        local_name(F.concat(F.lit("urn:x#"), clean_name("name"))).alias("local"))


@query
def distinct_supercategories(spark, sf):
    return triples.supercategories(roles.taxonomy(spark, sf))


@query
def group_triples(spark, sf):
    return triples.group_triples(roles.taxonomy(spark, sf), WORDS)


@query
def category_triples(spark, sf):
    return triples.category_triples(roles.taxonomy(spark, sf), WORDS)


@query
def ontology_triples(spark, sf):
    return triples.ontology(roles.taxonomy(spark, sf), WORDS)


@query
def triple_summary(spark, sf):
    return triples.triple_summary(triples.ontology(roles.taxonomy(spark, sf), WORDS))


@query
def example_classes(spark, sf):
    return triples.example_classes(triples.ontology(roles.taxonomy(spark, sf), WORDS))


@query
def triple_lines(spark, sf):
    return triples.triple_lines(triples.ontology(roles.taxonomy(spark, sf), WORDS))


# --- comparison ---------------------------------------------------------------------------------

@query
def compare_counts(spark, sf):
    return compare.compare_counts(*_with_sample(spark, sf, *TABLES))


@query
def compare_density(spark, sf):
    return compare.compare_density(*_with_sample(spark, sf, "images", "annotations"))


@query
def compare_coverage(spark, sf):
    return compare.compare_coverage(*_with_sample(spark, sf, "annotations", "segmentations"))


@query
def compare_previews(spark, sf):
    images = roles.tables(spark, sf)["images"].select("id", "license", "width")
    sample = sampling.stratified_sample(images, IMAGES_KEPT, stratum="license")
    return compare.compare_previews(images, sample, "id")


@query
def compare_methods(spark, sf):
    """Purchases against clicks: the two "methods", their event count and distinct users."""
    metrics = given(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))
    return compare.compare_methods(metrics, "event_type", "click", "purchase", "events", "users")


@query
def guarded_ratios(spark, sf):
    """Ratio and percentage difference with zero denominators in the data."""
    return given(spark, sf, "nation").select(
        "n_nationkey", ratio("n_regionkey", "n_nationkey").alias("part"),
        percent_change("n_regionkey", "n_nationkey").alias("change"))


# --- files: written to the shared folder, then read back ------------------------------------------

@query
def parquet_tables(spark, sf):
    """Counts of the eight tables after a Parquet export."""
    root = scratch_path(spark, "parquet")
    write_tables(roles.tables(spark, sf), root)
    return reports.table_counts(read_tables(spark, root))


@query
def appended_tables(spark, sf):
    """Counts of the eight tables after writing them and appending them again."""
    root = scratch_path(spark, "appended")
    write_tables(roles.tables(spark, sf), root)
    write_tables(roles.tables(spark, sf), root, mode="append")
    return reports.table_counts(read_tables(spark, root))


def _odd_texts(spark, sf):
    """The eight tables, with quotes, commas and line breaks in their texts."""
    t = roles.tables(spark, sf)
    odd = F.concat(F.lit('"a", '), "name", F.lit('\n\r\n \\"" ,'))
    for name in ("licenses", "categories", "attributes"):
        t[name] = t[name].withColumn("name", F.when(F.col("id") % 3 != 0, odd).otherwise(F.col("name")))
    t["images"] = t["images"].withColumn("file_name", F.when(F.col("id") % 2 == 0, F.concat(
        F.lit(" "), "file_name", F.lit("\n"))))
    return t


def _round_trip(spark, sf, fmt):
    """Rows of each table, and how many differ after writing and reading it."""
    root = scratch_path(spark, fmt)
    t = _odd_texts(spark, sf)
    write_tables(t, root, fmt)
    back = read_tables(spark, root, fmt)
    parts = []
    for name in TABLES:
        there = t[name].select(*[F.col(f.name).cast(f.dataType) for f in back[name].schema])
        marks = (there.select("*", F.lit(1).alias("_was"), F.lit(0).alias("_is"))
                 .unionByName(back[name].select("*", F.lit(0).alias("_was"), F.lit(1).alias("_is")))
                 .groupBy(*there.columns).agg(F.sum("_was").alias("_was"), F.sum("_is").alias("_is")))
        parts.append(marks.agg(F.coalesce(F.sum("_was"), F.lit(0)).alias("rows"),
                               F.coalesce(F.sum(F.abs(F.col("_was") - F.col("_is"))), F.lit(0)).alias("different"))
                     .select(F.lit(name).alias("table"), "rows", "different"))
    return reduce(DataFrame.unionByName, parts)


@query
def csv_tables(spark, sf):
    return _round_trip(spark, sf, "csv")


@query
def json_tables(spark, sf):
    return _round_trip(spark, sf, "json")


@query
def orc_tables(spark, sf):
    return _round_trip(spark, sf, "orc")


@query
def default_load(spark, sf):
    """Rows of the eight tables after a load with default options: every good row."""
    root = scratch_path(spark, "load")
    staging = scratch_path(spark, "load-staging")

    def stage(name, df):
        df.write.parquet(f"{staging}/{name}")
        return spark.read.parquet(f"{staging}/{name}")

    write_tables(shred_members(_raw(spark, sf), CHECKED, stage).tables, root)
    return reports.table_counts(read_tables(spark, root))


@query
def member_lines(spark, sf):
    """Annotations written as JSON lines and read back through the line reader."""
    path = scratch_path(spark, "lines")
    text = roles.document_text(spark, sf).where("member = 'annotations'")
    element = F.regexp_extract("text", r'^\{"annotations":\[(.*)\]\}$', 1)
    text.select(element.alias("value")).write.text(path)
    return shred.annotations_table(read_member_lines(spark, "annotations", path)["annotations"])


def _odd_lines(spark, sf):
    path = scratch_path(spark, "odd-lines")
    roles.odd_lines(spark, sf).select("line").write.text(path)
    return read_member_lines(spark, "images", path)


@query
def odd_line_images(spark, sf):
    """Images from lines some of which hold other types or are no JSON: those that convert."""
    return _odd_lines(spark, sf)["images"].select("id", "width", "height")


@query
def odd_line_account(spark, sf):
    """The same lines: how many were read, refused for a value, and refused as damaged."""
    raw = _odd_lines(spark, sf)
    parts = [("read", raw["images"]), ("unconverted", raw.unconverted), ("damaged", raw.damaged)]
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("kind"), "rows") for name, df in parts])


@query
def category_arrays(spark, sf):
    """Triples from categories written as JSON arrays, several files of one array each."""
    path = scratch_path(spark, "arrays")
    rows = roles.taxonomy(spark, sf)
    (rows.groupBy(F.floor(F.col("id") / 500).alias("file"))
     .agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
     .write.partitionBy("file").text(path))
    return triples.ontology(complete_categories(read_categories(spark, f"{path}/file=*")), WORDS)


@query
def document_files(spark, sf):
    """Licenses written as one JSON document per file and read back as documents."""
    path = scratch_path(spark, "documents")
    licenses = roles.document_text(spark, sf).where("member = 'licenses'").select("doc", "text")
    licenses.write.partitionBy("doc").text(path)
    raw = read_documents(spark, f"{path}/doc=*")
    return shred.licenses_table(raw["licenses"])


def _large_documents(spark, sf):
    """All members in a few large documents, thousands of elements each; gives their folder."""
    path = scratch_path(spark, "large-documents")
    roles.large_documents(spark, sf).write.partitionBy("bucket").text(path)
    return path


@query
def large_documents(spark, sf):
    """Annotations from large documents, read in byte ranges by several tasks each."""
    raw = read_large_documents(spark, f"{_large_documents(spark, sf)}/bucket=*", chunk_bytes=RANGE_BYTES)
    return shred.annotations_table(raw["annotations"])


@query
def large_document_load(spark, sf):
    """Rows of the eight tables after loading large documents; links that a list repeats are left out."""
    root = scratch_path(spark, "large-load")
    return reports.table_counts(load_documents(spark, f"{_large_documents(spark, sf)}/bucket=*", root,
                                               chunk_bytes=RANGE_BYTES))


@query
def bloom_matching(spark, sf):
    """Line items of urgent orders: a Bloom filter of the keys first, then the exact join."""
    orders = settle(given(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey"))
    lines = given(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return keep_matching(lines, orders, "l_orderkey", "o_orderkey", broadcast_rows=0)


@query
def refused_duplicates(spark, sf):
    """Line items published in two batches that overlap, keys checked against those stored: rows refused."""
    root = scratch_path(spark, "published")
    lines = given(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("annotation_id"), F.col("l_suppkey").alias("attribute_id"))
    publish(spark, {"annotation_attributes": lines.where("annotation_id % 3 <> 0")}, root, "first")
    refused = publish(spark, {"annotation_attributes": lines.where("annotation_id % 3 <> 1")}, root, "second", append=True)
    return refused.groupBy("key", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query
def published_counts(spark, sf):
    """Rows of published tables: a load, an append, the same append again, and one that stops half way."""
    root, t = scratch_path(spark, "published"), roles.tables(spark, sf)
    keyed = {n: t[n] for n in ("images", "categories", "attributes")}
    publish(spark, {**t, **{n: df.where("id % 2 = 0") for n, df in keyed.items()}}, root, "base")
    for _ in range(2):
        publish(spark, keyed, root, "more", append=True)
    # A load that has written its rows but not yet published them.
    write_tables(keyed, f"{root}/_loads/stopped")
    return reports.table_counts(read_tables(spark, root))


@query
def category_files(spark, sf):
    """Triples from categories written as JSON lines and read back."""
    path = f"{scratch_path(spark, 'categories')}.jsonl"
    roles.taxonomy(spark, sf).write.json(path)
    return triples.ontology(complete_categories(read_categories(spark, path)), WORDS)


@query
def triple_files(spark, sf):
    """Lines of the triple files written for the taxonomy."""
    path = scratch_path(spark, "triples")
    write_triples(triples.ontology(roles.taxonomy(spark, sf), WORDS), path, "nt")
    return spark.read.text(path)


@query
def triple_turtle(spark, sf):
    """Every statement in the Turtle files, grouped by subject, written for the taxonomy."""
    path = scratch_path(spark, "turtle")
    write_triples(triples.ontology(roles.taxonomy(spark, sf), WORDS), path, "turtle", WORDS)
    return read_grouped(spark, path, WORDS)


@query
def triple_xml(spark, sf):
    """Every statement in the RDF/XML files written for the taxonomy."""
    path = scratch_path(spark, "xml")
    write_triples(triples.ontology(roles.taxonomy(spark, sf), WORDS), path, "xml", WORDS)
    return read_xml(spark, path, WORDS)
