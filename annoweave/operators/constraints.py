"""Primary keys, checked where rows come in.

Within a batch the first row of a key stays and later ones are set apart. An append is also checked against the
keys of earlier loads. These are stored by bucket: neighbouring ids share a bucket, so a batch of new ids
reads the few buckets its own ids fall in, however many keys there are.

Keys are dealt to tasks of about ``TASK_ROWS`` rows each before they are counted, however many there are; a key held
by very many rows is dealt to several tasks first. Only rows of repeated keys are looked up. Rows with a null in
their key are no duplicates of each other and stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.operators.joins import BROADCAST_ROWS
from annoweave.session import settle

#: Consecutive ids of a bucket, and the number of buckets they are dealt to.
BUCKET_IDS = 1 << 16
BUCKETS = 1024
#: Key rows a task groups or sorts, and tasks that a key held by many rows is dealt to.
TASK_ROWS = 500_000
_SALTS = 64
REJECTED = "`table` string, key string, reason string, row string"


def bucket_of(key: str) -> Column:
    return F.pmod(F.expr(f"cast({key} as bigint) div {BUCKET_IDS}"), F.lit(BUCKETS)).cast("int")


def _complete(key: Sequence[str]) -> Column:
    whole = F.lit(True)
    for column in key:
        whole = whole & F.col(column).isNotNull()
    return whole


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def _repeated(keys: DataFrame, key: Sequence[str], *place: str) -> DataFrame:
    """The keys that occur more than once, and with ``place`` its least value as ``_first``; ``keys`` is stored.

    No task groups more than about ``TASK_ROWS`` different keys, before or after the shuffle.
    """
    count = keys.count()
    key = list(key)
    first = [F.min(place[0]).alias("_first")] if place else []
    if count <= TASK_ROWS:
        return keys.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *first).where("_n > 1")
    salt = F.pmod(F.spark_partition_id(), F.lit(_SALTS))
    dealt = keys.select(*key, *place, salt.alias("_salt")).repartition(_tasks(count), *key, "_salt")
    parts = dealt.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"), *first)
    again = [F.min("_first").alias("_first")] if place else []
    return (parts.drop("_salt").repartition(_tasks(count), *key)
            .groupBy(*key).agg(F.sum("_n").alias("_n"), *again).where("_n > 1"))


def with_repeats(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> list[str]:
    """The names of the tables in which a key occurs more than once, found in one job over the stored keys."""
    found = []
    for name, df in tables.items():
        stored = settle(df.where(_complete(keys[name])).select(*keys[name]))
        found.append(_repeated(stored, keys[name]).select(F.lit(name).alias("name")))
    if not found:
        return []
    return sorted(r["name"] for r in reduce(DataFrame.unionByName, found).distinct().collect())


def split_repeats(rows: DataFrame, key: Sequence[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, by ``order`` or else as stored, and the later ones.

    ``rows`` is computed once and stored. Where no key repeats, no row is looked up.
    """
    key = list(key)
    stored = settle(rows.withColumn("_row", F.monotonically_increasing_id()))
    place = F.struct(*([order] if order else []), "_row")
    keys = stored.where(_complete(key)).select(*key, place.alias("_place"))
    repeated = settle(_repeated(keys, key, "_place").select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)], F.col("_first._row").alias("_kept")))
    if repeated.isEmpty():
        return stored.drop("_row"), stored.drop("_row").limit(0)
    same = [F.col(c) == F.col(f"_key{i}") for i, c in enumerate(key)]
    marked = settle(stored.join(_small(repeated), same, "left"))
    extra = F.col("_kept").isNotNull() & (F.col("_kept") != F.col("_row"))
    return marked.where(~extra).select(*rows.columns), marked.where(extra).select(*rows.columns)


def stored_keys(spark: SparkSession, folders: Sequence[str], key: Sequence[str], buckets: Sequence[int]) -> DataFrame:
    """The keys of earlier loads in some buckets; other buckets' files are not read."""
    ddl = ", ".join(f"{c} bigint" for c in key) + ", _bucket int"
    if not folders:
        return spark.createDataFrame([], ddl)
    found = spark.read.schema(ddl).parquet(folders[0])
    for folder in folders[1:]:
        found = found.unionByName(spark.read.schema(ddl).parquet(folder))
    return found.where(F.col("_bucket").isin(list(buckets)))


def write_keys(rows: DataFrame, key: Sequence[str], folder: str) -> None:
    """Store the keys of accepted rows by bucket."""
    keys = rows.where(_complete(key)).select(*[F.col(c).cast("bigint").alias(c) for c in key],
                                             bucket_of(key[0]).alias("_bucket"))
    keys = settle(keys)
    # A bucket is written by one task, and tasks are not merged beyond this number.
    dealt = keys.repartition(min(BUCKETS, _tasks(keys.count())), "_bucket")
    dealt.sortWithinPartitions("_bucket", *key).write.partitionBy("_bucket").parquet(folder)


def split_known(rows: DataFrame, key: Sequence[str], folders: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with keys that no earlier load holds, and those whose key one does."""
    spark, key = rows.sparkSession, list(key)
    if not folders:
        return rows, rows.limit(0)
    rows = settle(rows)
    # At most BUCKETS numbers.
    buckets = [r["_bucket"] for r in rows.where(_complete(key)).select(bucket_of(key[0]).alias("_bucket")).distinct().collect()]
    earlier = stored_keys(spark, folders, key, buckets)
    own = rows.select(*key).where(_complete(key)).distinct()
    known = settle(own.join(earlier.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)]),
                            [F.col(c) == F.col(f"_key{i}") for i, c in enumerate(key)], "left_semi"))
    if known.isEmpty():
        return rows, rows.limit(0)
    known = _small(known)
    return rows.join(known, key, "left_anti").select(*rows.columns), rows.join(known, key, "left_semi").select(*rows.columns)


def rejected_rows(name: str, key: Sequence[str], rows: DataFrame, reason: str) -> DataFrame:
    """Rows set apart, as table, key, reason and text."""
    plain = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(F.lit(name).alias("table"), F.concat_ws(",", *[F.col(c).cast("string") for c in key]).alias("key"),
                       F.lit(reason).alias("reason"), F.to_json(F.struct(*plain)).alias("row"))
