"""DuckDB SQL for the registered queries, straight from the given tables.

The SQL restates what each query computes by arithmetic on the tables; it shares
no code with the operators beyond the sample sizes and the vocabulary.
"""

from __future__ import annotations

from annoweave.operators import triples
from catalog.queries import (
    CHILDREN_KEPT, FEW_STRATA_KEPT, IMAGES_KEPT, MANY_STRATA_KEPT, REPEATED_KEPT, WORDS)
from catalog.roles import CATEGORY_RANGE, NO_IMAGE

# The eight tables as common table expressions.
INFO = """select cast(year(max(o_orderdate)) as integer) as year, '1.0' as version,
    concat(count(*), ' orders') as description, cast(null as varchar) as contributor,
    cast(null as varchar) as url, strftime(min(o_orderdate), '%Y-%m-%d') as date_created from orders"""
LICENSES = """select cast(n_nationkey as bigint) as id, n_name as name,
    concat('/nation/', n_nationkey) as url from nation where n_nationkey <> 0"""
CATEGORIES = """select p_partkey as id, p_name as name, p_type as supercategory, p_size as level,
    p_brand as taxonomy_id from part"""
ATTRIBUTES = """select s_suppkey as id, s_name as name, concat('nation ', s_nationkey) as supercategory,
    s_nationkey as level, concat('sup', s_suppkey) as taxonomy_id from supplier"""
IMAGES = """select c_custkey as id, cast(400 + c_custkey % 800 as integer) as width,
    cast(300 + c_custkey % 500 as integer) as height, c_name as file_name,
    cast(nullif(c_nationkey, 0) as bigint) as license, cast(null as varchar) as time_captured,
    concat('/customer/', c_custkey) as original_url, c_custkey % 2 = 0 as isstatic,
    c_mktsegment as kaggle_id from customer"""
ANNOTATIONS = f"""select o_orderkey as id, o_custkey as image_id,
    (o_orderkey * 13 + o_custkey) % {CATEGORY_RANGE} as category_id from orders"""
LINKS = "select l_orderkey as annotation_id, l_suppkey as attribute_id from lineitem"
POINTS = """select vec_id as annotation_id, cast(0 as integer) as polygon_index,
    cast(k as integer) as point_index, cast(embedding[2 * k + 1] as double) as x_coord,
    cast(embedding[2 * k + 2] as double) as y_coord
    from (select vec_id, embedding, unnest(range(len(embedding) // 2)) as k from embeddings)"""

TABLES = {"info": INFO, "licenses": LICENSES, "categories": CATEGORIES, "attributes": ATTRIBUTES,
          "images": IMAGES, "annotations": ANNOTATIONS, "annotation_attributes": LINKS,
          "segmentations": POINTS}

# An order as the documents describe it.
ORDER_IMAGE = f"case when o_orderkey % 29 = 0 then o_custkey + {NO_IMAGE} else o_custkey end"
ORDER_CATEGORY = f"(o_orderkey * 13 + o_custkey) % {CATEGORY_RANGE}"
USABLE = "o_orderkey % 97 <> 0"
KEPT = (f"{USABLE} and o_orderkey % 29 <> 0 and o_custkey in (select c_custkey from customer) "
        f"and {ORDER_CATEGORY} in (select p_partkey from part)")
NO_BOX = "o_orderkey % 17 = 0"
DOCUMENT_ANNOTATION = f"""select o_orderkey as id, {ORDER_IMAGE} as image_id,
    {ORDER_CATEGORY} as category_id,
    cast(case when {NO_BOX} then 0 else o_custkey % 640 end as double) as bbox_x,
    cast(case when {NO_BOX} then 0 else o_orderkey % 480 end as double) as bbox_y,
    cast(case when {NO_BOX} then 0 else 100.5 end as double) as bbox_width,
    cast(case when {NO_BOX} then 0 else 50 end as double) as bbox_height,
    cast(o_custkey % 1000 + 0.25 as double) as area, o_orderstatus = 'P' as iscrowd from orders"""


def _document_links(rows: str, with_text: bool) -> str:
    parts = [f"select o_orderkey as annotation_id, o_orderkey % 100 as attribute_id from orders "
             f"where o_orderkey % 19 <> 0 and {rows}",
             f"select o_orderkey, (o_orderkey + 37) % 130 from orders "
             f"where o_orderkey % 19 <> 0 and {rows}"]
    if with_text:
        parts.append(f"select o_orderkey, cast(5 as bigint) from orders "
                     f"where o_orderkey % 19 <> 0 and o_orderkey % 3 = 0 and {rows}")
    return " union all ".join(parts)


def _document_pairs(rows: str) -> str:
    """Every coordinate pair of the document polygons, with the number that is there."""
    return f"""select o_orderkey as k, 0 as p, cast(i as integer) as i,
          o_custkey + 2 * i as x, o_custkey + 2 * i + 1.0 as y
        from (select *, unnest(range((o_orderkey % 9 + 1) // 2)) as i from orders
              where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and {rows})
        union all
        select o_orderkey, 1, 0, o_custkey, 0.5 from orders
        where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and {rows}"""


TEXT_NUMBER = "(p = 0 and i = 1 and k % 5 = 0)"
TEXT_OTHER = "(p = 0 and i = 1 and k % 7 = 0)"


def _document_points(rows: str, strict: bool) -> str:
    bad = f"{TEXT_NUMBER} or {TEXT_OTHER}" if strict else TEXT_OTHER
    return f"""select k as annotation_id, cast(p as integer) as polygon_index, i as point_index,
        cast(x as double) as x_coord, cast(y as double) as y_coord
        from ({_document_pairs(rows)}) where not ({bad})"""


def _count_all(tables: dict[str, str]) -> str:
    return " union all ".join(f"select '{n}' as \"table\", count(*) as rows from ({sql})"
                              for n, sql in tables.items())


def _unchanged() -> str:
    return f'select "table", rows, cast(0 as bigint) as different from ({_count_all(TABLES)})'


# --- sampling ---------------------------------------------------------------------------------

def _draw(seed: int, row_id: str) -> str:
    return f"md5(concat('{seed}|', cast({row_id} as varchar)))"


def _uniform(name: str, source: str, row_id: str, size: int, seed: int = 42) -> str:
    return (f"{name} as (select {row_id} as id from {source} "
            f"order by {_draw(seed, row_id)}, {row_id} limit {size})")


def _quota(name: str, source: str, row_id: str, stratum: str, size: int) -> str:
    return f"""{name}_q as (select {stratum} as s, count(*) as n, min({row_id}) as f,
          greatest(1, (count(*) * {size}) // (select count(*) from {source})) as raw
        from {source} group by 1),
      {name}_a as (select s, n, cast(case when (select count(*) from {source}) <= {size} then n
          else greatest(0, least(raw, {size} - coalesce(sum(raw) over (order by f
               rows between unbounded preceding and 1 preceding), 0))) end as bigint) as k
        from {name}_q)"""


def _stratified(name: str, source: str, row_id: str, stratum: str, size: int, seed: int = 42) -> str:
    return f"""{_quota(name, source, row_id, stratum, size)},
      {name}_r as (select {row_id} as id, {stratum} as s, {_draw(seed + 1, row_id)} as h2,
          row_number() over (partition by {stratum} order by {_draw(seed, row_id)}, {row_id}) as rn
        from {source}),
      {name}_f as (select r.id, r.h2, case when rn <= k then 0 else 1 end as rest
        from {name}_r r join {name}_a a on r.s is not distinct from a.s),
      {name} as (select id from {name}_f
        order by rest, case when rest = 0 then '' else h2 end, id limit {size})"""


CUSTOMER_SAMPLE = _stratified("imgs", "customer", "c_custkey", "c_mktsegment", IMAGES_KEPT)
CUSTOMER_CHILDREN = "kids as (select * from orders where o_custkey in (select id from imgs))"


def _customers(ctes: str, condition: str) -> str:
    return (f"with {ctes} select c_custkey, c_mktsegment, c_nationkey from customer "
            f"where c_custkey {condition}")


def _orders(ctes: str, name: str) -> str:
    return (f"with {ctes} select o_orderkey, o_custkey, o_orderpriority from orders "
            f"where o_orderkey in (select id from {name})")


DATASET_SAMPLE = f"""images as ({IMAGES}), annotations as ({ANNOTATIONS}),
    {_stratified("imgs", "images", "id", "license", IMAGES_KEPT)},
    kids as (select * from annotations where image_id in (select id from imgs)),
    {_stratified("anns", "kids", "id", "category_id", CHILDREN_KEPT)}"""
UNIFORM_DATASET_SAMPLE = f"""images as ({IMAGES}), annotations as ({ANNOTATIONS}),
    {_uniform("imgs", "images", "id", IMAGES_KEPT)},
    kids as (select * from annotations where image_id in (select id from imgs)),
    {_uniform("anns", "kids", "id", CHILDREN_KEPT)}"""
SAMPLED_TABLES = {
    **TABLES,
    "images": f"select * from ({IMAGES}) where id in (select id from imgs)",
    "annotations": f"select * from ({ANNOTATIONS}) where id in (select id from anns)",
    "annotation_attributes": f"select * from ({LINKS}) where annotation_id in (select id from anns)",
    "segmentations": f"select * from ({POINTS}) where annotation_id in (select id from anns)",
}


def _density(images: str, annotations: str) -> str:
    return f"""select count(distinct i.id) as unique_images, count(a.id) as total_annotations,
        count(a.id) // nullif(count(distinct i.id), 0) as annotations_per_image,
        count(a.id) / nullif(count(distinct i.id), 0) as mean_annotations_per_image
        from ({images}) i left join ({annotations}) a on i.id = a.image_id"""


def _coverage(annotations: str, points: str) -> str:
    return f"""select count(distinct a.id) as annotations_joined,
        count(distinct s.annotation_id) as annotations_with_points,
        count(s.annotation_id) as total_points
        from ({annotations}) a left join ({points}) s on a.id = s.annotation_id"""


def _side_by_side(ctes: str, metrics: list[str], full: str, sample: str) -> str:
    rows = " union all ".join(
        f"select '{m}' as metric, cast(f.{m} as double) as \"full\", cast(s.{m} as double) as sample "
        f"from ({full}) f, ({sample}) s" for m in metrics)
    return f"""with {ctes} select *, case when "full" > 0 then sample / "full" else 0.0 end as ratio
        from ({rows})"""


# --- taxonomy -----------------------------------------------------------------------------------

TAXONOMY = """select p_partkey as id, concat(p_type, ', ', p_name, ' - ', p_size) as name,
    concat(p_type, '-', p_brand) as supercategory, p_size as level, p_brand as taxonomy_id from part"""
BASE = WORDS.base


def _clean(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[ ,_-]+', '_', 'g'), '_')"


def _facts(source: str, subject: str, facts: list[tuple[str, str, str, str | None]]) -> str:
    return " union all ".join(
        f"select {subject} as subject, '{p}' as predicate, cast({value} as varchar) as object, "
        f"'{kind}' as object_kind, cast({'null' if dt is None else repr(dt)} as varchar) as datatype "
        f"from ({source})" for p, value, kind, dt in facts)


GROUPS = _facts(
    f"select distinct supercategory from ({TAXONOMY})",
    f"concat('{BASE}supercategory_', {_clean('supercategory')})",
    [(triples.RDF_TYPE, f"'{triples.CLASS}'", "iri", None),
     (triples.LABEL, "supercategory", "literal", None),
     (triples.COMMENT, "concat('Supercategory for ', supercategory, ' clothing items')", "literal", None),
     (triples.SUBCLASS, f"'{BASE}ClothingItem'", "iri", None)])
MEMBERS = _facts(
    TAXONOMY, f"concat('{BASE}category_', {_clean('name')})",
    [(triples.RDF_TYPE, f"'{triples.CLASS}'", "iri", None),
     (triples.LABEL, "name", "literal", None),
     (triples.COMMENT, "concat('Clothing category: ', name)", "literal", None),
     (triples.SUBCLASS, f"concat('{BASE}supercategory_', {_clean('supercategory')})", "iri", None),
     (f"{BASE}hasCategoryId", "id", "literal", triples.INTEGER),
     (f"{BASE}hasTaxonomyId", "taxonomy_id", "literal", None),
     (f"{BASE}hasLevel", "level", "literal", triples.INTEGER)])
# The statements about the ontology, its properties and the root class.
FIXED = [
    ("DatasetOntology", triples.RDF_TYPE, triples.ONTOLOGY, "iri"),
    ("DatasetOntology", triples.LABEL, "Dataset Ontology", "literal"),
    ("DatasetOntology", triples.COMMENT, "Ontology for Dataset clothing taxonomy", "literal"),
    ("DatasetOntology", triples.VERSION, "1.0", "literal"),
    ("DatasetOntology", triples.SEE_ALSO, "http://example.org/dataset", "literal"),
    ("hasCategoryId", triples.RDF_TYPE, triples.DATATYPE_PROPERTY, "iri"),
    ("hasCategoryId", triples.LABEL, "has category ID", "literal"),
    ("hasCategoryId", triples.RANGE, triples.INTEGER, "iri"),
    ("hasTaxonomyId", triples.RDF_TYPE, triples.DATATYPE_PROPERTY, "iri"),
    ("hasTaxonomyId", triples.LABEL, "has taxonomy ID", "literal"),
    ("hasTaxonomyId", triples.RANGE, triples.TEXT, "iri"),
    ("hasLevel", triples.RDF_TYPE, triples.DATATYPE_PROPERTY, "iri"),
    ("hasLevel", triples.LABEL, "has level", "literal"),
    ("hasLevel", triples.RANGE, triples.INTEGER, "iri"),
    ("ClothingItem", triples.RDF_TYPE, triples.CLASS, "iri"),
    ("ClothingItem", triples.LABEL, "Clothing Item", "literal"),
    ("ClothingItem", triples.COMMENT, "Base class for all clothing items", "literal"),
]
STATEMENTS = " union all ".join(
    f"select '{BASE}{s}' as subject, '{p}' as predicate, '{o}' as object, '{k}' as object_kind, "
    "cast(null as varchar) as datatype" for s, p, o, k in FIXED)
ONTOLOGY = f"select distinct * from ({STATEMENTS} union all {GROUPS} union all {MEMBERS})"
CLASSES = (f"select subject from ({ONTOLOGY}) where predicate = '{triples.RDF_TYPE}' "
           f"and object = '{triples.CLASS}'")
LINES = f"""select concat('<', subject, '> <', predicate, '> ',
    case when object_kind = 'iri' then concat('<', object, '>')
         when datatype is not null then concat('"', object, '"^^<', datatype, '>')
         else concat('"', object, '"') end, ' .') as value from ({ONTOLOGY})"""


def _usage(items: str, uses: str, key: str) -> str:
    return f"""select i.id, i.name, i.supercategory, count(u.{key}) as "count"
        from ({items}) i left join ({uses}) u on i.id = u.{key}
        group by i.id, i.name, i.supercategory"""


def _top(sql: str) -> str:
    return f'{sql} order by "count" desc, id limit 10'


def _audit() -> str:
    def missing(child: str, column: str, parent: str, nullable: bool) -> str:
        skip = f"and {column} is not null" if nullable else ""
        return (f"select '{child}' as \"table\", '{column}' as \"column\", '{parent}' as \"references\", "
                f"count(*) as violations from ({TABLES[child]}) c where not exists "
                f"(select 1 from ({TABLES[parent]}) p where p.id = c.{column}) {skip}")
    return " union all ".join([
        missing("images", "license", "licenses", True),
        missing("annotations", "image_id", "images", False),
        missing("annotations", "category_id", "categories", False),
        missing("annotation_attributes", "annotation_id", "annotations", False),
        missing("annotation_attributes", "attribute_id", "attributes", False),
        missing("segmentations", "annotation_id", "annotations", False)])


def _keys() -> str:
    def repeated(table: str, key: str) -> str:
        return (f"select '{table}' as \"table\", '{key}' as \"key\", count(*) as violations from "
                f"(select {key} from ({TABLES[table]}) group by {key} having count(*) > 1)")
    return " union all ".join([
        repeated("licenses", "id"), repeated("categories", "id"), repeated("attributes", "id"),
        repeated("images", "id"), repeated("annotations", "id"),
        repeated("annotation_attributes", "annotation_id,attribute_id"),
        repeated("segmentations", "annotation_id,polygon_index,point_index")])


def _statistics() -> str:
    counts = [f"(select count(*) from ({sql})) as {name}_count" for name, sql in TABLES.items()]
    counts += [f"(select count(*) from ({TABLES[name]})) as total_{name}"
               for name in ("annotations", "images", "categories", "attributes")]
    return "select " + ", ".join(counts)


def _preview() -> str:
    pick = "select {0} as side, id, license, width from ({1}) order by id limit 3"
    return (f"with {DATASET_SAMPLE} select * from ({pick.format(repr('full'), IMAGES)}) union all "
            f"select * from ({pick.format(repr('sample'), SAMPLED_TABLES['images'])})")


def _methods() -> str:
    def side(kind: str, measure: str) -> str:
        return f"(select cast({measure} as double) from events where event_type = '{kind}')"
    rows = " union all ".join(
        f"select '{name}' as measure, {side('click', sql)} as base, {side('purchase', sql)} as other"
        for name, sql in (("events", "count(*)"), ("users", "count(distinct user_id)")))
    return f"select *, (other - base) / base * 100 as percent_change from ({rows})"


DOCUMENT_IMAGES = """select c_custkey as id, cast(400 + c_custkey % 800 as integer) as width,
    cast(300 + c_custkey % 500 as integer) as height, c_name as file_name,
    cast(nullif(c_nationkey, 0) as bigint) as license, cast(null as varchar) as time_captured,
    cast(null as varchar) as original_url, c_custkey % 2 = 0 as isstatic,
    c_mktsegment as kaggle_id from customer"""
DOCUMENT_LICENSES = """select cast(n_nationkey as bigint) as id, n_name as name,
    cast(null as varchar) as url from nation"""

ORACLES: dict[str, str] = {
    "top_categories": _top(_usage(CATEGORIES, "select l_partkey from lineitem", "l_partkey")),
    "top_attributes": _top(_usage(ATTRIBUTES, LINKS, "attribute_id")),
    "category_usage": _usage(CATEGORIES, ANNOTATIONS, "category_id"),
    "attribute_usage": _usage(ATTRIBUTES, LINKS, "attribute_id"),
    "image_summary": f"""select count(*) as total_images, avg(width) as avg_width,
        avg(height) as avg_height, count(distinct license) as unique_licenses from ({IMAGES})""",
    "table_counts": _count_all(TABLES),
    "table_statistics": _statistics(),
    "relationship_density": _density(IMAGES, ANNOTATIONS),
    "segmentation_coverage": _coverage(ANNOTATIONS, POINTS),
    "image_ids": "select distinct c_custkey as id from customer",
    "category_preview": f"{CATEGORIES} order by id limit 3",
    "shred_info": """select cast(year(max(o_orderdate)) as integer) as year, '1.0' as version,
        cast(null as varchar) as description, cast(null as varchar) as contributor,
        cast(null as varchar) as url, strftime(min(o_orderdate), '%Y-%m-%d') as date_created
        from orders""",
    "shred_licenses": f"{DOCUMENT_LICENSES} where n_nationkey <> 0",
    "shred_licenses_raw": DOCUMENT_LICENSES,
    "shred_categories": CATEGORIES,
    "shred_attributes": ATTRIBUTES,
    "shred_images": DOCUMENT_IMAGES,
    "zero_license_count": "select count(*) as nullified from customer where c_nationkey = 0",
    "shred_annotations": f"{DOCUMENT_ANNOTATION} where {USABLE}",
    "rejected_boxes": f"select o_orderkey as id from orders where not ({USABLE})",
    "shred_links": _document_links(USABLE, True),
    "shred_points_strict": _document_points(USABLE, True),
    "shred_points_coerced": _document_points(USABLE, False),
    "rejected_points": f"""select k as annotation_id, cast(p as integer) as polygon_index,
        i as point_index, cast(x as varchar) as x,
        case when {TEXT_OTHER} then 'x' else cast(x + 1 as varchar) end as y
        from ({_document_pairs(USABLE)}) where {TEXT_NUMBER} or {TEXT_OTHER}""",
    "polygon_points": POINTS,
    "kept_annotations": f"{DOCUMENT_ANNOTATION} where {KEPT}",
    "kept_links": f"select * from ({_document_links(KEPT, False)}) where attribute_id in "
                  "(select s_suppkey from supplier)",
    "kept_points": _document_points(KEPT, True),
    "reference_audit": _audit(),
    "key_audit": _keys(),
    "duplicate_keys": 'select l_orderkey, l_linenumber, count(*) as "count" from lineitem '
                      "group by 1, 2 having count(*) > 1",
    "missing_categories": f"select distinct category_id as id from ({ANNOTATIONS}) where category_id "
                          "not in (select p_partkey from part)",
    "sample_quota": f"with {_quota('q', 'customer', 'c_custkey', 'c_mktsegment', IMAGES_KEPT)} "
                    "select s as c_mktsegment, n as size, k as take from q_a",
    "stratified_sample": _customers(CUSTOMER_SAMPLE, "in (select id from imgs)"),
    "stratified_sample_few": _customers(
        _stratified("imgs", "customer", "c_custkey", "c_mktsegment", FEW_STRATA_KEPT),
        "in (select id from imgs)"),
    "stratified_sample_many_strata": f"""with a as ({ANNOTATIONS}),
        {_stratified("anns", "a", "id", "category_id", MANY_STRATA_KEPT)}
        select id, category_id from a where id in (select id from anns)""",
    "stratified_sample_null_stratum": f"""with i as ({IMAGES}),
        {_stratified("imgs", "i", "id", "license", IMAGES_KEPT)}
        select id, license from i where id in (select id from imgs)""",
    "direct_stratified_sample": _orders(
        _stratified("anns", "orders", "o_orderkey", "o_orderpriority", CHILDREN_KEPT), "anns"),
    "uniform_sample": _customers(_uniform("imgs", "customer", "c_custkey", IMAGES_KEPT),
                                 "in (select id from imgs)"),
    "direct_uniform_sample": _orders(_uniform("anns", "orders", "o_orderkey", CHILDREN_KEPT), "anns"),
    "child_stratified_sample": _orders(
        f"{CUSTOMER_SAMPLE}, {CUSTOMER_CHILDREN}, "
        + _stratified("anns", "kids", "o_orderkey", "o_orderpriority", CHILDREN_KEPT), "anns"),
    "child_uniform_sample": _orders(
        f"{CUSTOMER_SAMPLE}, {CUSTOMER_CHILDREN}, "
        + _uniform("anns", "kids", "o_orderkey", CHILDREN_KEPT), "anns"),
    "unsampled_rows": _customers(_uniform("imgs", "customer", "c_custkey", IMAGES_KEPT),
                                 "not in (select id from imgs)"),
    "referential_sample": f"with {DATASET_SAMPLE} select 'images' as \"table\", id from imgs "
                          "union all select 'annotations', id from anns",
    "referential_sample_uniform": f"with {UNIFORM_DATASET_SAMPLE} select 'images' as \"table\", id "
                                  "from imgs union all select 'annotations', id from anns",
    "clean_names": f"""select id, {_clean('name')} as cleaned,
        concat('{BASE}category_', {_clean('name')}) as uri, {_clean('name')} as "local"
        from ({TAXONOMY})""",
    "distinct_supercategories": f"select distinct supercategory from ({TAXONOMY})",
    "group_triples": GROUPS,
    "category_triples": MEMBERS,
    "ontology_triples": ONTOLOGY,
    "triple_summary": f"""select count(*) as triples,
        count(*) filter (where predicate = '{triples.RDF_TYPE}' and object = '{triples.CLASS}') as classes,
        count(*) filter (where object = '{triples.OBJECT_PROPERTY}') as object_properties,
        count(*) filter (where object = '{triples.DATATYPE_PROPERTY}') as data_properties
        from ({ONTOLOGY})""",
    "example_classes": f"""select * from (select subject as class, cast(null as bigint) as more
          from ({CLASSES}) order by subject limit 5)
        union all select '... and more', greatest(count(*) - 5, 0) from ({CLASSES})""",
    "triple_lines": LINES,
    "compare_counts": f"""with {DATASET_SAMPLE}
        select f."table", f.rows as "full", s.rows as sample,
          case when f.rows > 0 then s.rows / f.rows else 0.0 end as ratio
        from ({_count_all(TABLES)}) f join ({_count_all(SAMPLED_TABLES)}) s on f."table" = s."table" """,
    "compare_density": _side_by_side(
        DATASET_SAMPLE, ["unique_images", "total_annotations", "annotations_per_image",
                         "mean_annotations_per_image"],
        _density(IMAGES, ANNOTATIONS),
        _density(SAMPLED_TABLES["images"], SAMPLED_TABLES["annotations"])),
    "compare_coverage": _side_by_side(
        DATASET_SAMPLE, ["annotations_joined", "annotations_with_points", "total_points"],
        _coverage(ANNOTATIONS, POINTS),
        _coverage(SAMPLED_TABLES["annotations"], SAMPLED_TABLES["segmentations"])),
    "compare_previews": _preview(),
    "compare_methods": _methods(),
    "guarded_ratios": """select n_nationkey,
        case when n_nationkey > 0 then n_regionkey / n_nationkey else 0.0 end as part,
        case when n_regionkey = 0 then null
             else (n_nationkey - n_regionkey) / n_regionkey * 100 end as change from nation""",
    "parquet_tables": _count_all(TABLES),
    "member_lines": f"{DOCUMENT_ANNOTATION} where {USABLE}",
    "large_documents": f"{DOCUMENT_ANNOTATION} where {USABLE}",
    "large_document_load": _count_all({
        "info": "select 1", "licenses": f"{DOCUMENT_LICENSES} where n_nationkey <> 0",
        "categories": CATEGORIES, "attributes": ATTRIBUTES, "images": DOCUMENT_IMAGES,
        "annotations": f"select 1 from orders where {KEPT}",
        "annotation_attributes": f"select distinct * from ({_document_links(KEPT, False)}) where attribute_id in "
                                 "(select s_suppkey from supplier)",
        "segmentations": _document_points(KEPT, True)}),
    "bloom_matching": """select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in
        (select o_orderkey from orders where o_orderpriority = '1-URGENT')""",
    "refused_duplicates": """with k as (
            select l_orderkey % 3 as part, l_orderkey || ',' || l_suppkey as key, count(*) as n from lineitem group by 1, 2)
        select key, 'repeated' as reason, n - 1 as rows from k where part <> 1 and n > 1
        union all select key, 'loaded before', 1 from k where part = 2""",
    "published_counts": _count_all({**TABLES, **{
        n: f"select distinct id from ({TABLES[n]})" for n in ("images", "categories", "attributes", "annotations")},
        "annotation_attributes": "select distinct l_orderkey, l_suppkey from lineitem"}),
    "document_files": f"{DOCUMENT_LICENSES} where n_nationkey <> 0",
    "category_files": ONTOLOGY,
    "triple_files": LINES,
    "sampling_gate": """select (select count(*) from customer) as images,
        (select count(*) from orders) as annotations,
        (select count(*) from customer) > 10000 or (select count(*) from orders) > 10000 as "large" """,
    "orphan_annotations": f"""select id, category_id from ({ANNOTATIONS}) where category_id not in
        (select p_partkey from part)""",
    "orphaned_annotations": f"""select id, image_id, category_id from
        ({DOCUMENT_ANNOTATION} where {USABLE} and not ({KEPT}))""",
    "orphaned_links": f"select * from ({_document_links(USABLE, False)}) where attribute_id not in "
                      "(select s_suppkey from supplier)",
    "referential_sample_all_images": f"""with annotations as ({ANNOTATIONS}),
        {_uniform("direct", "annotations", "id", CHILDREN_KEPT)}
        select 'images' as "table", c_custkey as id from customer
        union all select 'annotations', id from direct""",
    "uniform_sample_repeated_ids": f"""select l_orderkey, count(*) as rows from
        (select l_orderkey from lineitem order by {_draw(42, "l_orderkey")} limit {REPEATED_KEPT})
        group by l_orderkey""",
    "stratified_sample_repeated_ids": f"select cast({REPEATED_KEPT} as bigint) as rows, "
                                      f"cast(0 as bigint) as foreign_rows from "
                                      f"(select count(*) n from lineitem) where n >= {REPEATED_KEPT}",
    "appended_tables": f'select "table", 2 * rows as rows from ({_count_all(TABLES)})',
    "csv_tables": _unchanged(),
    "json_tables": _unchanged(),
    "orc_tables": _unchanged(),
    "default_load": _count_all({
        "info": "select 1", "licenses": f"{DOCUMENT_LICENSES} where n_nationkey <> 0",
        "categories": CATEGORIES, "attributes": ATTRIBUTES, "images": DOCUMENT_IMAGES,
        "annotations": f"select 1 from orders where {KEPT}",
        "annotation_attributes": f"select 1 from ({_document_links(KEPT, False)}) where attribute_id in "
                                 "(select s_suppkey from supplier)",
        "segmentations": _document_points(KEPT, True)}),
    "odd_line_images": """select c_custkey as id,
        cast(case when c_custkey % 10 = 3 then 640 else c_nationkey end as integer) as width,
        cast(case when c_custkey % 10 = 3 then 480 end as integer) as height
        from customer where c_custkey % 10 not in (1, 2, 4, 5)""",
    "odd_line_account": """select 'read' as kind, count(*) as rows from customer
          where c_custkey % 10 not in (1, 2, 4, 5)
        union all select 'unconverted', count(*) from customer where c_custkey % 10 in (2, 4, 5)
        union all select 'damaged', count(*) from customer where c_custkey % 10 = 1""",
    "category_arrays": ONTOLOGY,
    "triple_turtle": ONTOLOGY,
    "triple_xml": ONTOLOGY,
}
