"""Documents in, eight tables out: the whole load job."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.operators import shred
from annoweave.operators.compare import compare_methods
from annoweave.operators.constraints import REJECTED, rejected_rows, split_repeats, with_repeats
from annoweave.operators.sampling import Keys, Targets, referential_sample
from annoweave.schemas import PRIMARY_KEYS
from annoweave.session import scratch_path
from annoweave.sinks.tables import folder_bytes, remove_folder, save_tables, write_tables
from annoweave.sinks.versions import publish
from annoweave.sources.chunks import CHUNK_BYTES, largest_file, read_large_documents
from annoweave.sources.documents import Raw, read_documents, read_member_files
from annoweave.sources.tables import Tables, catalog_tables, create_tables, read_tables

#: From so many bytes on, a document is read in ranges.
LARGE_DOCUMENT = 128 << 20
_KEYS = Keys(image_order="_order", annotation_order="_order")


@dataclass(frozen=True)
class LoadOptions:
    """What to check, how to read coordinates, and whether and how to sample.

    A load writes every good row unless a sample is asked for, by ``sample_size`` or the small mode.
    """

    enforce: bool = True          # keep only rows whose references exist; drop license 0
    strict: bool = True           # coordinates must be JSON numbers, not numeric text
    sample_size: int | None = None
    small_dataset_mode: bool = False
    method: str = "stratified"
    all_images: bool = False      # when sampling: keep every image and sample annotations alone
    fail_on_rejects: bool = False  # unreadable documents, lines or values end the load
    seed: int = 42

    @property
    def targets(self) -> Targets | None:
        if self.sample_size is None and not self.small_dataset_mode:
            return None
        return Targets.of(self.sample_size, self.small_dataset_mode)


# The two behaviours a load can have: references enforced and strata kept, or
# rows taken as they come and sampled uniformly.
CHECKED = LoadOptions()
UNCHECKED = LoadOptions(enforce=False, strict=False, method="uniform")

# Kinds of rows left out; the last two only when references are enforced.
REJECTS = ("damaged", "unconverted", "boxes", "points", "annotations", "links")
_KEYED = ("licenses", "categories", "attributes", "images", "annotations")


@dataclass(frozen=True)
class Shredded:
    """The eight tables, and what was left out of them or changed on the way.

    ``rejects`` has ``damaged`` (documents and lines), ``unconverted`` (rows with a value of the wrong
    kind), ``boxes``, ``points``, and, when references are enforced, ``annotations`` and ``links``
    without a parent and ``licenses``, the number of placeholder licenses that became NULL.
    """

    tables: Tables
    rejects: Tables


Stage = Callable[[str, DataFrame], DataFrame]


def shred_members(raw: Raw, options: LoadOptions = CHECKED,
                  stage: Stage = lambda name, df: df) -> Shredded:
    """Sample if asked, check references, and split the members into tables.

    ``stage`` may store an intermediate and return it as read back: images and
    annotations are staged once parsed, and annotations again once checked, so
    parsing and reference joins happen once for all the tables made from them.
    """
    images, found = stage("images", raw["images"]), stage("annotations", raw["annotations"])
    rejects = {"damaged": raw.damaged, "unconverted": raw.unconverted, "boxes": shred.rejected_boxes(found)}
    if options.targets is not None:
        images, found = referential_sample(images, found, options.targets, keys=_KEYS, seed=options.seed,
                                           method=options.method, all_images=options.all_images)
    kept = shred.boxed(found)
    if options.enforce:
        boxed, kept = kept, stage("kept", shred.kept_annotations(kept, images, raw["categories"]))
        rejects["annotations"] = shred.orphaned_annotations(boxed, images, raw["categories"])
        rejects["licenses"] = shred.zero_license_count(images)
    links = shred.annotation_links(kept, numbers_only=options.enforce)
    if options.enforce:
        rejects["links"] = shred.orphaned_links(links, raw["attributes"])
        links = shred.known_links(links, raw["attributes"])
    rejects["points"] = shred.rejected_points(kept, options.strict)
    tables = {
        "info": shred.info_table(raw["info"]),
        "licenses": shred.licenses_table(raw["licenses"], drop_zero=options.enforce),
        "categories": shred.categories_table(raw["categories"]),
        "attributes": shred.attributes_table(raw["attributes"]),
        "images": shred.images_table(images, null_zero=options.enforce),
        "annotations": shred.annotations_table(kept),
        "annotation_attributes": links,
        "segmentations": shred.polygon_points(kept, options.strict),
    }
    return Shredded(tables, rejects)


def _write_rejects(spark: SparkSession, rejects: Tables, root: str, fmt: str) -> None:
    for name, df in rejects.items():
        writer = df.write.mode("overwrite")
        if fmt == "catalog":
            writer.saveAsTable(f"`{root}`.`rejected_{name}`")
        else:
            writer.parquet(f"{root.rstrip('/')}/rejects/{name}")


def read_rejects(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One reject table of a load into files. They are Parquet, whatever the tables are."""
    return spark.read.parquet(f"{root.rstrip('/')}/rejects/{name}")


def rejects_report(spark: SparkSession, root: str, names: tuple[str, ...] = REJECTS) -> DataFrame:
    """Rows left out of a load into files, by kind."""
    counts = [read_rejects(spark, root, n).agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit(n).alias("kind"), "rows") for n in names]
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    return report


def first_of_keys(rows: Tables, keys: Mapping[str, Sequence[str]], order: str | None = None) -> tuple[Tables, DataFrame]:
    """Keep the first row of each key, in the order of the input if it is known; gives the others as well.

    One job over the keys of all tables finds those with repeats, if any; only their rows are stored and sorted out.
    """
    kept, repeated = dict(rows), []
    for name in with_repeats({n: rows[n] for n in keys}, keys):
        kept[name], extra = split_repeats(rows[name], keys[name], order)
        repeated.append(rejected_rows(name, keys[name], extra, "repeated"))
    spark = next(iter(rows.values())).sparkSession
    return kept, reduce(DataFrame.unionByName, repeated, spark.createDataFrame([], REJECTED))


def _refuse(raw: Raw, repeated: DataFrame) -> None:
    for kind, df in (("damaged", raw.damaged), ("unconverted", raw.unconverted), ("duplicate", repeated)):
        if first := df.take(3):
            raise ValueError(f"{kind} input: {[r.asDict() for r in first]}"[:2000])


def _load(spark: SparkSession, read: Callable[[Stage], Raw], root: str, options: LoadOptions,
          fmt: str, staging: str | None, load_id: str | None = None, append: bool = False) -> Tables:
    if load_id is not None and fmt == "catalog" or append and load_id is None:
        raise ValueError("a published load needs an id and a folder")
    folder = staging or scratch_path(spark, "staging")

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    try:
        raw = read(stage)
        first, repeated = first_of_keys(raw, {name: ("id",) for name in _KEYED}, "_order")
        raw.update(first)
        if options.fail_on_rejects:
            _refuse(raw, repeated)
        result = shred_members(raw, options, stage)
        links = "annotation_attributes"
        tables, twice = first_of_keys(result.tables, {links: PRIMARY_KEYS[links]})
        repeated = repeated.unionByName(twice)
        if load_id is not None:
            repeated = repeated.unionByName(publish(spark, tables, root, load_id, append=append, fmt=fmt,
                                                    fail_on_duplicates=options.fail_on_rejects))
        elif fmt == "catalog":
            create_tables(spark, root)
            save_tables(tables, root)
        else:
            write_tables(tables, root, fmt)
        _write_rejects(spark, {**result.rejects, "duplicates": repeated}, root, fmt)
    finally:
        if staging is None:
            remove_folder(spark, folder)
    return catalog_tables(spark, root) if fmt == "catalog" else read_tables(spark, root, fmt)


def load_documents(spark: SparkSession, path: str | list[str], root: str,
                   options: LoadOptions = CHECKED, *, fmt: str = "parquet",
                   staging: str | None = None, chunk_bytes: int | None = None,
                   load_id: str | None = None, append: bool = False) -> Tables:
    """Read JSON documents, write the tables below ``root`` and read them back.

    Documents are read whole, one task each, unless one of them is large or ``chunk_bytes`` is given:
    then all are read in byte ranges.

    ``fmt`` is a file format, or ``catalog`` to treat ``root`` as a database name.
    What was left out is written next to the tables: of rows with one primary key all but the first, among
    others. Staged intermediates are kept when ``staging`` names a folder for them, and removed otherwise.

    With ``load_id`` the tables appear together once all are written (see ``sinks.versions``): in place of
    those there, or with ``append`` in addition to them, without rows whose key an earlier load has.
    """
    def read(stage: Stage) -> Raw:
        if chunk_bytes is None and largest_file(spark, path) < LARGE_DOCUMENT:
            return read_documents(spark, path, stage)
        return read_large_documents(spark, path, stage, chunk_bytes=chunk_bytes or CHUNK_BYTES)

    return _load(spark, read, root, options, fmt, staging, load_id, append)


def load_lines(spark: SparkSession, folder: str, root: str, options: LoadOptions = CHECKED, *,
               fmt: str = "parquet", staging: str | None = None, load_id: str | None = None,
               append: bool = False) -> Tables:
    """The same for ``<member>.jsonl`` files below ``folder``: the layout for large data."""
    return _load(spark, lambda stage: read_member_files(spark, folder), root, options, fmt, staging, load_id, append)


def compare_loads(spark: SparkSession, path: str | list[str], root: str, *,
                  sample_size: int | None = None) -> DataFrame:
    """Load the same documents both ways and report the difference in time and size."""
    rows = []
    for name, options in (("checked", CHECKED), ("unchecked", UNCHECKED)):
        started = time.monotonic()
        target = f"{root.rstrip('/')}/{name}"
        load_documents(spark, path, target, replace(options, sample_size=sample_size))
        rows.append((name, time.monotonic() - started, folder_bytes(spark, target)))
    metrics = spark.createDataFrame(rows, "method string, seconds double, bytes bigint")
    return compare_methods(metrics, "method", "checked", "unchecked", "seconds", "bytes")
