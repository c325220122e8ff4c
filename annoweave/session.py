"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "annoweave", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` wins over the defaults.

    Shuffle partitions are left to the cluster: they depend on its size, and
    adaptive execution coalesces them when there are too many.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, input_bytes: int, partition_bytes: int = 128 << 20) -> int:
    """Start shuffles with enough partitions for an input of this size.

    Adaptive execution merges those that turn out small, so too many is the safe side.
    """
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                     -(-input_bytes // partition_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    return partitions


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting, whose executors share the driver's disk, gets a
    folder of its own; it is removed with the session's process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="annoweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder, removed by ``clear_scratch``."""
    path = f"{shared_folder(spark).rstrip('/')}/annoweave-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go with the end of the write.

    Else they stay until the driver collects its garbage, and pile up from step to step.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Compute ``df`` once: write it as Parquet below the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, so a lost executor does not lose it; later steps
    read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete the files of results of ``settle`` that no later step reads; other tables are passed over."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path in _written:
            discard(table.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one scratch path that no later step reads."""
    _written.remove(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete this process's scratch files, once no result needs them; says how many paths."""
    done = 0
    while _written:
        target = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return done


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
