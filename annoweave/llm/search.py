"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, several times over: first passes only count scores in
histograms, each narrowing the range that holds a query's k-th best score, until that score is known;
the last pass lets through what reaches it and breaks ties by the smaller id. Scores are never stored
or shuffled; a task sends at most k counts or candidates of a query.

Queries go in blocks of a bounded number of bytes, which alone are broadcast; candidates stay where
they are read. Defined cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; only vectors of one length are compared; rows that repeat an id are
separate candidates, while a query id asks once, with the least of its vectors, and never finds its
own id; a query with fewer than k candidates gets them all; empty tables give no rows. Scores beyond a
long are cut to its range. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annoweave.llm.common import stored

K = 20
SCALE = 64
BINS = 256
#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 8 << 20
_CELLS = 1 << 21  # scores held at once
_HELD = 1 << 20  # candidates a task holds before it drops those that cannot win
_EXACT = 2.0 ** 52
_LONG = 2 ** 63 - 1


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer parts of ``scale`` times each component."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")))


class _Block:
    """Queries of one length and, for each, the range of scores still in question."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, widest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        bound = np.ceil(norms * widest) + 1
        self.exact = not len(bound) or float(bound.max()) < _EXACT
        kind = np.float64 if self.exact else object
        self.vectors = vectors.astype(kind)
        limits = [min(int(b), _LONG) for b in bound]
        self.low = np.array([-b for b in limits], dtype=kind)  # scores in question start here ...
        self.width = np.array([-(-(2 * b + 1) // BINS) for b in limits], dtype=kind)  # ... in such bins
        self.end = np.array([b + 1 for b in limits], dtype=kind)  # ... and end before this one
        self.above = np.zeros(len(ids), dtype=np.int64)  # candidates known to lie above the range
        self.floor = np.array([-b for b in limits], dtype=kind)  # the k-th best score, once known

    def scores(self, columns: list[pa.Array]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of the score matrix: queries, candidate ids, scores, and what is to be ignored."""
        ids = columns[0].to_numpy(zero_copy_only=False)
        flat = columns[1].flatten().to_numpy(zero_copy_only=False)
        kind = np.float64 if self.exact else object
        vectors = flat.reshape(len(ids), -1).astype(kind) if len(ids) else np.zeros((0, 0))
        rows = max(1, min(len(self.ids), 2048))
        step = max(1, _CELLS // rows)
        for a in range(0, len(ids), step):
            some = ids[a:a + step]
            for q in range(0, len(self.ids), rows):
                part = slice(q, min(q + rows, len(self.ids)))
                found = self.vectors[part] @ vectors[a:a + step].T
                if not self.exact:
                    found = np.minimum(np.maximum(found, -_LONG), _LONG)
                yield part, some, found, self.ids[part][:, None] == some[None, :]


def _same_length(batch: pa.RecordBatch, length: int) -> list[pa.Array]:
    import pyarrow.compute as pc
    keep = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), length))
    return [keep.column(0), keep.column(1)]


def _count(block, length: int, k: int):
    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        bins = np.zeros((len(b.ids), BINS), dtype=np.int64)
        for batch in batches:
            for part, _, scores, own in b.scores(_same_length(batch, length)):
                at = np.floor_divide(scores - b.low[part, None], b.width[part, None])
                good = (at >= 0) & (scores < b.end[part, None]) & ~own
                row = np.broadcast_to(np.arange(part.start, part.stop)[:, None], scores.shape)[good]
                bins += np.bincount(row * BINS + at[good].astype(np.int64),
                                    minlength=bins.size).reshape(bins.shape)
        # From the top down to the bin in which this task alone has enough.
        before = bins[:, ::-1].cumsum(axis=1)[:, ::-1] - bins
        q, bin_ = np.nonzero((bins > 0) & (before < (k - b.above)[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(bin_), pa.array(bins[q, bin_])],
                                         ["q", "bin", "n"])
    return counts


def _best(ids, scores, queries, k):
    order = np.lexsort((ids, -scores, queries))
    ids, scores, queries = ids[order], scores[order], queries[order]
    first = np.flatnonzero(np.concatenate(([True], queries[1:] != queries[:-1])))
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    keep = place < k
    return ids[keep], scores[keep], queries[keep]


def _pick(block, length: int, k: int):
    def picked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        ids = scores = queries = np.zeros(0, dtype=np.int64)
        parts, held = [], 0

        def merged():
            return _best(*(np.concatenate([p[i] for p in parts]) for i in range(3)), k)

        for batch in batches:
            for part, some, found, own in b.scores(_same_length(batch, length)):
                q, c = np.nonzero((found >= b.floor[part, None]) & ~own)
                if len(q):
                    parts.append(_best(some[c], found[q, c].astype(np.int64), q + part.start, k))
                    held += len(parts[-1][0])
                    if held > _HELD:
                        parts = [merged()]
                        held = len(parts[0][0])
        if parts:
            ids, scores, queries = merged()
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids[queries]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])
    return picked


def _narrow(b: _Block, candidates: DataFrame, length: int, k: int) -> None:
    """Histogram passes until the k-th best score of every query is known."""
    spark = candidates.sparkSession
    while True:
        shared = spark.sparkContext.broadcast(b)
        sums = (candidates.mapInArrow(_count(shared, length, k), "q long, bin long, n long")
                .groupBy("q", "bin").agg(F.sum("n").alias("n")))
        above = spark.createDataFrame([(i, int(n)) for i, n in enumerate(b.above)], "q long, above long")
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        found = (sums.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(above), "q")
                 .where((F.col("upto") + F.col("above") >= k)
                        & (F.col("upto") - F.col("n") + F.col("above") < k))
                 .select("q", "bin", (F.col("upto") - F.col("n")).alias("more")).collect())
        shared.unpersist()
        single = b.width.astype(object) <= 1
        for q, bin_, more in found:  # at most one row for each query of the block
            b.low[q] += b.width[q] * bin_
            b.above[q] += more
            b.floor[q] = b.low[q]
            b.end[q] = min(b.end[q], b.low[q] + b.width[q])
            b.width[q] = -(-int(b.width[q]) // BINS)
        short = set(range(len(b.ids))) - {row[0] for row in found}
        for q in short:  # fewer than k candidates in all: every one of them is in
            b.width[q] = 1
        if all(single[q] or q in short for q in range(len(b.ids))):
            return


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """The k highest inner products of each query: query_id, rank, vec_id, score.

    Both sides have vec_id (long) and v (array of long).
    """
    spark = candidates.sparkSession
    candidates = stored(candidates.select("vec_id", "v"), "search-candidates")
    queries = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "search-queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    shape = {r["length"]: r["widest"] for r in candidates.groupBy(F.size("v").alias("length"))
             .agg(F.max(norm).alias("widest")).collect()}
    asked = queries.groupBy(F.size("v").alias("length")).count().collect()
    parts = []
    for length, count in asked:
        if length not in shape:
            continue
        blocks = -(-count * max(1, length) * 8 // BLOCK_BYTES)
        for number in range(blocks):
            mine = (F.size("v") == length) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number)
            rows = queries.where(mine).collect()  # bounded by BLOCK_BYTES
            if not rows:
                continue
            ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
            vectors = np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), length)
            block = _Block(ids, vectors, shape[length])
            _narrow(block, candidates, length, k)
            shared = spark.sparkContext.broadcast(block)
            parts.append(candidates.mapInArrow(_pick(shared, length, k),
                                               "query_id long, vec_id long, score long"))
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for part in parts:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
