"""Loads that appear whole or not at all.

A load writes its tables, and their keys, below a folder of its own; they become visible by one small file, the
next manifest, which names for each table the folders that make it up. A replacing load names its own folders
alone, an appending one those of the manifest before as well. Readers resolve the newest manifest, so a load
that stops half way leaves them what they had, and a reader sees all tables of a load or none. A load has
an id: repeating one that a manifest already holds changes nothing.

    root/_manifests/000000000001.json   {"loads": [id, ...], "tables": {name: [folder, ...]}, "keys": {...}}
    root/_loads/<id>-<unique>/<table>   the rows of one load, and _keys/<table>
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from annoweave.operators.constraints import (
    REJECTED, rejected_rows, split_known, split_repeats, with_repeats, write_keys)
from annoweave.schemas import PRIMARY_KEYS
from annoweave.session import settle
from annoweave.sinks.tables import FILE_FORMATS, remove_folder, write_tables
from annoweave.sources.manifests import EMPTY, file_names, hadoop_file, manifest


def _publish(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Create the manifest of that number; fails if another load has published it meanwhile.

    The file is written beside its place and moved there, which no reader sees half done.
    """
    folder = f"{root.rstrip('/')}/_manifests"
    files, target = hadoop_file(spark, f"{folder}/{number:012d}.json")
    _, draft = hadoop_file(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise RuntimeError(f"another load was published below {root} meanwhile; repeat this one")


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, load_id: str, *, append: bool = False,
            fmt: str = "parquet", fail_on_duplicates: bool = False) -> DataFrame:
    """Write tables as one load and make them visible together; the rows refused for their key.

    Rows whose primary key occurred earlier in the batch, or with ``append`` in an earlier load, are refused, or
    end the load before anything is visible. A load id that is published already writes nothing and refuses
    nothing.
    """
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown file format: {fmt}")
    refused = spark.createDataFrame([], REJECTED)
    before = manifest(spark, root)
    if load_id in before["loads"]:
        return refused
    if append and before["format"] not in (None, fmt):
        raise ValueError(f"the tables below {root} are stored as {before['format']}")
    old = before if append else {**EMPTY, "number": before["number"], "format": None}
    own = f"_loads/{re.sub('[^A-Za-z0-9_.-]', '_', load_id)}-{uuid.uuid4().hex}"
    place = f"{root.rstrip('/')}/{own}"
    accepted = {}
    repeated = with_repeats({n: df for n, df in tables.items() if n in PRIMARY_KEYS}, PRIMARY_KEYS)
    for name, rows in tables.items():
        key = PRIMARY_KEYS.get(name)
        if name in repeated:
            rows, twice = split_repeats(rows, key)
            refused = refused.unionByName(rejected_rows(name, key, twice, "repeated"))
        earlier = old["keys"].get(name)
        if earlier:
            rows, known = split_known(rows, key, [f"{root.rstrip('/')}/{f}" for f in earlier])
            refused = refused.unionByName(rejected_rows(name, key, known, "loaded before"))
        accepted[name] = rows
    refused = settle(refused)
    if fail_on_duplicates and (first := refused.take(3)):
        raise ValueError(f"duplicate keys: {[r.asDict() for r in first]}"[:2000])
    write_tables(accepted, place, fmt)
    keyed = [name for name in accepted if name in PRIMARY_KEYS]
    for name in keyed:
        write_keys(spark.read.schema(accepted[name].schema).format(fmt).load(f"{place}/{name}") if fmt in ("parquet", "orc")
                   else accepted[name], PRIMARY_KEYS[name], f"{place}/_keys/{name}")
    names = set(old["tables"]) | set(accepted)
    _publish(spark, root, before["number"] + 1, {
        "format": fmt, "loads": [*old["loads"], load_id],
        "tables": {n: old["tables"].get(n, []) + ([f"{own}/{n}"] if n in accepted else []) for n in sorted(names)},
        "keys": {n: old["keys"].get(n, []) + ([f"{own}/_keys/{n}"] if n in keyed else []) for n in sorted(names)}})
    return refused


def remove_unpublished(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders of loads that the newest manifest does not name: stopped or replaced ones.

    Not to be run while a load is under way, or while a reader of a replaced load is.
    """
    found = manifest(spark, root)
    used = {folder.split("/")[1] for kind in ("tables", "keys") for parts in found[kind].values() for folder in parts}
    gone = [name for name in file_names(spark, f"{root.rstrip('/')}/_loads") if name not in used]
    for name in gone:
        remove_folder(spark, f"{root.rstrip('/')}/_loads/{name}")
    return gone
