"""Line deduplication: later copies of repeated runs of lines are deleted.

The corpus is one sequence of lines, by doc_id (null first) and place. Its suffix array comes from prefix
doubling: lines that occur once cannot be in a repeated run and drop out; a rank is the number of suffixes
before the group of those that share their first lines; each round splits the groups by the ranks of what
follows these lines, and a suffix alone in its group keeps its rank and is sorted no more. A run ends with
its document and before a line that occurs once. Once all ranks differ they are the suffix array.

The longest common prefix of neighbours is put together from the ranks of each round, longest first.
Neighbours that share ``min_lines`` lines or more form intervals; all but the first position of an interval
begin a later copy. ``runs`` gives the maximal repeated runs themselves.

Deleted are the lines of runs of at least ``min_lines`` lines that occur before, and every line of at
least ``min_words`` words that does.

Defined cases: a null text stays null and has no lines; an empty text has one empty line; a text all of
whose lines go becomes empty; lines differ if a character does. Rows with the same doc_id and text are
one document and get the same result; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from annoweave.llm.common import stored, word_count
from annoweave.session import release

MIN_LINES = 3
MIN_WORDS = 3
_PLACE = ("doc", "version", "pos")


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _version() -> Column:
    return F.xxhash64("text")


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Whether two rows are of one place."""
    return a["doc"].eqNullSafe(b["doc"]) & (a["version"] == b["version"]) & (a["pos"] == b["pos"])


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows stored in order; ``part`` and ``place`` tell where each row stands."""
    ordered = rows.orderBy(*keys).withColumn("part", F.spark_partition_id())
    return stored(ordered.withColumn("place", F.monotonically_increasing_id()), "line-order")


def _upto() -> WindowSpec:
    """The rows of a partition up to each one."""
    return Window.partitionBy("part").orderBy("place")


def _carried(ordered: DataFrame, total: Column, add) -> DataFrame:
    """What the partitions before each one come to, as a table of one row for each partition."""
    found, now = [], None
    for row in ordered.groupBy("part").agg(total.alias("total")).orderBy("part").collect():
        found.append((row["part"], now))
        now = row["total"] if now is None else add(now, row["total"])
    return F.broadcast(ordered.sparkSession.createDataFrame(found, "part int, carried long"))


def _starts(keys: DataFrame) -> DataFrame:
    """``keys`` (k1, k2 and n, the rows of each) with ``start``: the rows of all smaller keys."""
    ordered = _sorted(keys, "k1", "k2")
    before = _carried(ordered, F.sum("n"), lambda a, b: a + b)
    start = F.sum("n").over(_upto()) - F.col("n") + F.coalesce("carried", F.lit(0))
    starts = stored(ordered.join(before, "part").withColumn("start", start).drop("part", "place", "carried"),
                    "line-starts")
    release(ordered)
    return starts


def _split(level: DataFrame, size: int) -> DataFrame:
    """Ranks by the first ``2 * size`` lines from those by the first ``size``."""
    here = level.where("n > 1").select(*_PLACE, F.col("rank").alias("k1"))
    there = level.select("doc", "version", (F.col("pos") - size).alias("pos"), F.col("rank").alias("k2"))
    # What ends there, or goes on with a line that occurs once, is like no other.
    alone = F.xxhash64(*[here[c] for c in _PLACE]).bitwiseOR(F.lit(-2 ** 63))
    keyed = stored(here.join(there, _same(here, there), "left").select(
        *[here[c] for c in _PLACE], "k1", F.coalesce("k2", alone).alias("k2")), "line-keys")
    starts = _starts(keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")))
    groups = starts.groupBy("k1").agg(F.min("start").alias("group_start"))
    new = starts.join(groups, "k1").select("k1", "k2", "n", (
        F.col("k1") + F.col("start") - F.col("group_start")).alias("rank"))
    moved = keyed.join(new, ["k1", "k2"]).select(
        *_PLACE, "rank", "n", F.when(F.col("n") > 1, 2 * size).otherwise(size).alias("reach"))
    split = stored(level.where("n = 1").unionByName(moved), "line-ranks")
    release(keyed, starts)
    return split


def _levels(first: DataFrame) -> list[tuple[int, DataFrame]]:
    """Ranks by 1, 2, 4, ... lines until all differ: columns of a place, rank, n (suffixes of that
    rank) and reach (the most lines, by these steps, that the suffix shares with another)."""
    levels = [(1, first)]
    while not levels[-1][1].where("n > 1").isEmpty():
        size = levels[-1][0]
        levels.append((2 * size, _split(levels[-1][1], size)))
    return levels


def _neighbours(levels: list[tuple[int, DataFrame]], least: int) -> DataFrame:
    """Neighbours in the suffix array that share at least ``least`` lines.

    Columns: a place, rank, the place before it in the array (named prev_*) and lcp, the lines shared.
    """
    reach = 1 << (least.bit_length() - 1)
    array = levels[-1][1].where(F.col("reach") >= reach)
    before = array.select((F.col("rank") + 1).alias("rank"), *[F.col(c).alias(f"prev_{c}") for c in _PLACE])
    pairs = array.select(*_PLACE, "rank").join(before, "rank").withColumn("lcp", F.lit(0))
    for size, level in reversed(levels[:-1]):
        shared = level.where("n > 1")
        for side in ("", "prev_"):
            ranks = shared.select(*[F.col(c).alias(f"at_{c}") for c in _PLACE], F.col("rank").alias(f"{side}found"))
            pairs = pairs.join(ranks, F.col(f"{side}doc").eqNullSafe(F.col("at_doc"))
                               & (F.col(f"{side}version") == F.col("at_version"))
                               & (F.col(f"{side}pos") + F.col("lcp") == F.col("at_pos")), "left").drop(
                                   *[f"at_{c}" for c in _PLACE])
        more = F.when(F.col("found") == F.col("prev_found"), size).otherwise(0)
        last = pairs
        pairs = stored(pairs.withColumn("lcp", F.col("lcp") + more).drop("found", "prev_found"), "line-pairs")
        release(last)
    found = stored(pairs.where(F.col("lcp") >= least), "line-neighbours")
    release(pairs)
    return found


def _later(array: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places of an interval of ``pairs`` that are not its first in the corpus."""
    rows = array.select(*_PLACE, "rank").join(pairs.select("rank", "lcp"), "rank", "left").select(
        *_PLACE, "rank", F.when(F.col("lcp").isNull(), F.col("rank")).alias("head"))
    ordered = _sorted(rows, "rank")
    before = _carried(ordered, F.max("head"), lambda a, b: a if b is None else b)
    named = ordered.join(before, "part").select(
        *_PLACE, F.coalesce(F.max("head").over(_upto()), "carried").alias("interval"))
    named = stored(named, "line-intervals")
    release(ordered)
    first = named.groupBy("interval").agg(F.min(F.struct(*_PLACE)).alias("first"),
                                          F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(first, "interval").where(F.struct(*_PLACE) != F.col("first")).select(*_PLACE)


def _places(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Places of lines that occur more than once: their ranks, and those of long later copies."""
    rows = docs.where("text is not null").select(
        F.col("doc_id").alias("doc"), _version().alias("version"), F.posexplode(_lines()).alias("pos", "line"))
    # Two hashes name a line: 128 bits.
    rows = rows.select(*_PLACE, F.xxhash64("line").alias("k1"),
                       F.xxhash64(F.lit("line"), "line").alias("k2"), (word_count("line") >= min_words).alias("long"))
    rows = rows.dropDuplicates(list(_PLACE))
    often = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"),
                                         F.min(F.struct(*_PLACE)).alias("first")).where("n > 1")
    starts = _starts(often)
    level = stored(rows.join(starts, ["k1", "k2"]).select(
        *_PLACE, F.col("start").alias("rank"), "n", F.lit(1).alias("reach"),
        (F.col("long") & (F.struct(*_PLACE) != F.col("first"))).alias("copy")), "line-ranks")
    release(starts)
    return level.drop("copy"), level.where("copy").select(*_PLACE)


def runs(docs: DataFrame, *, min_lines: int = MIN_LINES) -> DataFrame:
    """The maximal repeated runs: doc, version, pos and n_lines of each.

    A run is the longest one from its place that occurs elsewhere too (the two may overlap), is of at
    least ``min_lines`` lines, and is not the rest of one that begins a line before.
    """
    first, _ = _places(docs, 0)
    levels = _levels(first)
    pairs = _neighbours(levels, min_lines)
    ends = pairs.select(*_PLACE, "lcp").unionByName(
        pairs.select(*[F.col(f"prev_{c}").alias(c) for c in _PLACE], "lcp"))
    longest = stored(ends.groupBy(*_PLACE).agg(F.max("lcp").alias("n_lines")), "line-runs")
    release(pairs, *[level for _, level in levels[1:]])
    longer = longest.select("doc", "version", (F.col("pos") + 1).alias("pos"),
                            (F.col("n_lines") - 1).alias("n_lines"))
    return longest.join(longer, _same(longest, longer) & (longest["n_lines"] == longer["n_lines"]), "left_anti")


def repeated(docs: DataFrame, *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, version and ``gone``: the places of the lines to delete, for documents with any."""
    first, gone = _places(docs, min_words)
    levels = _levels(first)
    reach = 1 << (min_lines.bit_length() - 1)
    pairs = _neighbours(levels, min_lines)
    starts = _later(levels[-1][1].where(F.col("reach") >= reach), pairs)
    # Its intervals are stored, so the array and all it came from have been read.
    release(pairs, *[level for _, level in levels[1:]])
    every = F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1))
    gone = gone.unionByName(starts.select("doc", "version", F.explode(every).alias("pos")))
    return gone.groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))


def without_repeats(docs: DataFrame, *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with deleted lines taken out of their text.

    Adds ``n_lines`` and ``n_deleted`` (columns of these names give way).
    """
    found = repeated(docs, min_lines=min_lines, min_words=min_words)
    own = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    whole = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("_doc"), _version().alias("_version"))
    joined = whole.join(found, whole["_doc"].eqNullSafe(found["doc"])
                        & (whole["_version"] == found["version"]), "left")
    lines = _lines("row.text")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull() | F.col("row.text").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in own]
    return joined.select(
        *columns, F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("gone")), F.lit(0)).cast("long").alias("n_deleted"))
