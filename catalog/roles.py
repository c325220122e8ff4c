"""The given tables cast in the roles of an annotated dataset.

customer plays images, orders plays annotations, part plays categories, supplier
plays attributes, nation plays licenses (it has a placeholder id 0), lineitem
plays the attribute links and embeddings plays the polygons.

``tables`` casts them directly as the eight typed tables. ``documents`` writes
every row as a JSON document instead, with the irregularities real annotation
files have, so the shredding operators run on data of the same size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annoweave.operators.shred import polygon_points
from annoweave.sources.documents import Raw, documents_from_text

# Orders refer to part keys below this number, whether or not such a part exists.
CATEGORY_RANGE = 2500
# Added to the image id of some annotations, so that no image matches.
NO_IMAGE = 10_000_000_000


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def table(name: str) -> DataFrame:
        return given(spark, sf_dir, name)
    return {
        "info": table("orders").agg(
            F.year(F.max("o_orderdate")).alias("year"), F.lit("1.0").alias("version"),
            F.concat(F.count(F.lit(1)).cast("string"), F.lit(" orders")).alias("description"),
            F.lit(None).cast("string").alias("contributor"), F.lit(None).cast("string").alias("url"),
            F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("date_created")),
        "licenses": table("nation").where("n_nationkey <> 0").selectExpr(
            "cast(n_nationkey as bigint) id", "n_name name",
            "concat('/nation/', n_nationkey) url"),
        "categories": categories(spark, sf_dir),
        "attributes": table("supplier").selectExpr(
            "s_suppkey id", "s_name name", "concat('nation ', s_nationkey) supercategory",
            "s_nationkey level", "concat('sup', s_suppkey) taxonomy_id"),
        "images": table("customer").selectExpr(
            "c_custkey id", "cast(400 + c_custkey % 800 as int) width",
            "cast(300 + c_custkey % 500 as int) height", "c_name file_name",
            "cast(nullif(c_nationkey, 0) as bigint) license", "cast(null as string) time_captured",
            "concat('/customer/', c_custkey) original_url", "c_custkey % 2 = 0 isstatic",
            "c_mktsegment kaggle_id"),
        "annotations": table("orders").selectExpr(
            "o_orderkey id", "o_custkey image_id",
            f"(o_orderkey * 13 + o_custkey) % {CATEGORY_RANGE} category_id",
            "cast(o_custkey % 640 as double) bbox_x", "cast(o_orderkey % 480 as double) bbox_y",
            "100.5D bbox_width", "50D bbox_height", "o_totalprice area",
            "o_orderstatus = 'P' iscrowd"),
        "annotation_attributes": table("lineitem").selectExpr(
            "l_orderkey annotation_id", "l_suppkey attribute_id"),
        "segmentations": polygon_points(polygons(spark, sf_dir)),
    }


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "part").selectExpr(
        "p_partkey id", "p_name name", "p_type supercategory", "p_size level",
        "p_brand taxonomy_id")


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as categories with one name per type and size, so that names repeat."""
    return given(spark, sf_dir, "part").selectExpr(
        "p_partkey id", "concat(p_type, ', ', p_name, ' - ', p_size) name",
        "concat(p_type, '-', p_brand) supercategory", "p_size level", "p_brand taxonomy_id")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed polygons: each embedding is one polygon of x, y pairs."""
    return given(spark, sf_dir, "embeddings").selectExpr(
        "vec_id id", "array(cast(embedding as array<double>)) segmentation")


def _documents_of(df: DataFrame, member: str, key: str, body: str) -> DataFrame:
    """One document per row: ``member`` with a single element."""
    return df.selectExpr(f"'{member}' member", f"concat('{member}/', cast({key} as string)) doc",
                         f"concat('{{\"{member}\":[', {body}, ']}}') text")


def _annotation_text() -> str:
    """SQL text that writes an order as a JSON annotation.

    Boxes may be missing or too short, attribute lists may be missing or hold
    text, crowd flags are numbers or booleans, polygons may be missing, an
    object, of odd length, or hold numeric and other text.
    """
    value = """case when i = 2 and o_orderkey % 5 = 0 then concat('"', o_custkey + i, '"')
                    when i = 3 and o_orderkey % 7 = 0 then '"x"'
                    else cast(o_custkey + i as string) end"""
    return f"""concat(
        '{{"id":', o_orderkey,
        ',"image_id":', if(o_orderkey % 29 = 0, o_custkey + {NO_IMAGE}, o_custkey),
        ',"category_id":', (o_orderkey * 13 + o_custkey) % {CATEGORY_RANGE},
        case when o_orderkey % 97 = 0 then ',"bbox":[1,2]'
             when o_orderkey % 17 = 0 then ''
             else concat(',"bbox":[', o_custkey % 640, ',', o_orderkey % 480, ',100.5,50]') end,
        ',"area":', o_custkey % 1000, '.25',
        ',"iscrowd":', if(o_orderkey % 2 = 0, if(o_orderstatus = 'P', '1', '0'),
                                              if(o_orderstatus = 'P', 'true', 'false')),
        if(o_orderkey % 19 = 0, '',
           concat(',"attribute_ids":[', o_orderkey % 100, ',', (o_orderkey + 37) % 130,
                  if(o_orderkey % 3 = 0, ',"5"', ''), ']')),
        case when o_orderkey % 11 = 0 then ',"segmentation":{{"counts":[1,2],"size":[3,4]}}'
             when o_orderkey % 13 = 0 then ''
             else concat(',"segmentation":[[',
                         array_join(transform(sequence(0, cast(o_orderkey % 9 as int)),
                                              i -> {value}), ','),
                         '],[', o_custkey, ',0.5]]') end,
        '}}')"""


def _taxon_text(key: str, name: str, group: str, level: str, code: str) -> str:
    return (f"to_json(named_struct('id', {key}, 'name', {name}, 'supercategory', {group}, "
            f"'level', {level}, 'taxonomy_id', {code}))")


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of five tables as a JSON document: columns ``member``, ``doc`` and ``text``.

    A filter on ``member`` leaves one table of the union to be read.
    """
    def table(name: str) -> DataFrame:
        return given(spark, sf_dir, name)
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    # License ids appear as numbers and as text, the placeholder zero included.
    def license_text(key: str, odd: str) -> str:
        return f"if({odd} % 2 = 1, cast({key} as string), concat('\"', {key}, '\"'))"
    parts = [
        _documents_of(table("nation"), "licenses", "n_nationkey",
                      f"concat('{{\"id\":', {license_text('n_nationkey', 'n_nationkey')}, "
                      "',\"name\":\"', n_name, '\"}')"),
        _documents_of(table("part"), "categories", "p_partkey",
                      _taxon_text("p_partkey", "p_name", "p_type", "p_size", "p_brand")),
        _documents_of(table("supplier"), "attributes", "s_suppkey",
                      _taxon_text("s_suppkey", "s_name", "concat('nation ', s_nationkey)",
                                  "s_nationkey", "concat('sup', s_suppkey)")),
        _documents_of(table("customer"), "images", "c_custkey",
                      "concat('{\"id\":', c_custkey, ',\"width\":', 400 + c_custkey % 800, "
                      "',\"height\":', 300 + c_custkey % 500, ',\"file_name\":\"', c_name, "
                      f"'\",\"license\":', {license_text('c_nationkey', 'c_custkey')}, "
                      "',\"isstatic\":', if(c_custkey % 2 = 0, 'true', '0'), "
                      "',\"kaggle_id\":\"', c_mktsegment, '\"}')"),
        _documents_of(orders, "annotations", "o_orderkey", _annotation_text()),
        table("orders").selectExpr("max(o_orderdate) last_day", "min(o_orderdate) first_day").selectExpr(
            "'info' member", "'info' doc", "concat('{\"info\":{\"year\":', year(last_day), ',\"version\":\"1.0\","
            "\"date_created\":\"', date_format(first_day, 'yyyy-MM-dd'), '\"}}') text"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def documents(spark: SparkSession, sf_dir: str) -> Raw:
    return documents_from_text(document_text(spark, sf_dir), "text", "doc", "member")


def large_documents(spark: SparkSession, sf_dir: str, rows_per_document: int = 4000) -> DataFrame:
    """The elements of ``document_text`` in large documents: columns ``bucket`` and ``value``, lines in order.

    Each document has every member; a line is an element or what stands around it.
    """
    text = document_text(spark, sf_dir)
    order = ("info", "licenses", "categories", "attributes", "images", "annotations")
    count = max(1, -(-text.count() // rows_per_document))
    part = F.array_position(F.array(*map(F.lit, order)), F.col("member")).cast("int")
    inner = F.regexp_extract("text", r'^\{"\w+":\[?(.*?)\]?\}$', 1)
    rows = text.select(F.when(F.col("member") == "info", 0).otherwise(F.pmod(F.xxhash64("doc"), F.lit(count))).alias("bucket"),
                       part.alias("part"), F.col("doc").alias("place"), inner.alias("value"))
    first = Window.partitionBy("bucket", "part").orderBy("place")
    rows = rows.select("bucket", "part", F.lit(1).alias("step"), "place", F.concat(
        F.when(F.row_number().over(first) > 1, ",").otherwise(""), "value").alias("value"))
    around = []
    for i, name in enumerate(order):
        if name == "info":
            around += [(i + 1, 0, "{"), (i + 1, 2, "")]
        else:
            around += [(i + 1, 0, f'"{name}":['), (i + 1, 2, "]" if name == order[-1] else "],")]
    around += [(len(order) + 1, 3, "}")]
    lines = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(s).alias("step"), F.lit(v).alias("value")) for p, s, v in around])
    frame = spark.range(count).select(F.col("id").alias("bucket"), F.inline(lines))
    frame = frame.select("bucket", "part", "step", F.lit("").alias("place"), "value")
    # The document with the info member names it before its first element.
    rows = rows.withColumn("value", F.when(F.col("part") == 1, F.concat(F.lit('"info":'), "value", F.lit(","))).otherwise(F.col("value")))
    return (rows.unionByName(frame).repartition(count, "bucket").sortWithinPartitions("bucket", "part", "step", "place")
            .select("bucket", "value"))


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON lines of images, some with values of another type and some not JSON at all."""
    return given(spark, sf_dir, "customer").selectExpr(
        "c_custkey", """case when c_custkey % 10 = 1 then concat('{"id":', c_custkey, ',"width":')
            when c_custkey % 10 = 2 then concat('{"id":', c_custkey, ',"width":800.5}')
            when c_custkey % 10 = 3 then concat('{"id":"', c_custkey, '","width":"640","height":480.0}')
            when c_custkey % 10 = 4 then concat('{"id":"n', c_custkey, '","width":1}')
            when c_custkey % 10 = 5 then concat('{"id":', c_custkey, ',"license":true}')
            else concat('{"id":', c_custkey, ',"width":', c_nationkey, '}') end line""")
