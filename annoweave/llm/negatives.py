"""Hard-negative mining with Four-Russians scoring.

Every anchor is scored against every row. The anchor's components go in groups of eight; for each group a
table holds the sums of all 256 subsets. A row is kept as the bit planes of its components (two's
complement), packed into one byte for a group and a plane. Looking the byte up gives what the plane adds
for the group, and shifting and adding the planes gives the exact inner product without a multiplication.

Two passes over the rows follow for each block of anchors. The first keeps the best rows of the anchor's
own label, its positives; the second keeps, for each positive, the best rows of another label whose score
lies in the asked share of the positive's. A task sends no more rows than are asked for each anchor and
positive; scores are never stored or shuffled. Anchors go in blocks of a bounded number of bytes, which
alone are collected and broadcast; the results of a block are written before the next one starts.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
only vectors of one length are compared; rows that repeat an id are separate candidates, while an anchor's
id asks once, with the least of its (vector, label), and never finds its own id; an anchor with fewer rows
than asked gets them all; one without positives, and a positive without negatives, give no rows; empty
tables give none. Components and scores beyond a long are cut to its range. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annoweave.llm.common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score as a percentage of the positive's: at least, at most.
SHARE = (50, 95)
#: Bytes of anchor vectors that are collected and broadcast at once.
BLOCK_BYTES = 4 << 20
_TILE = 128  # anchors whose tables are held at once
_ROWS = (256, 4096)  # rows scored at once: at first, so that the floors rise early, and later
_BUCKETS = 16  # labels are scored against rows of their own bucket
_LONG = 2 ** 63 - 1
_PACKED = "vec_id long, label long, length int, planes binary"


def labelled_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the integer parts of ``scale`` times each component."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return rows.where(there & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def planes_of(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of integer rows, lowest first, eight components to a byte: rows x planes x groups."""
    bits = (vectors[:, None, :] >> np.arange(planes, dtype=np.int64)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """For each group of eight components the sums of its 256 subsets: groups x 256 x anchors."""
    count, size = anchors.shape
    groups = -(-size // 8)
    padded = np.zeros((count, groups * 8), dtype=anchors.dtype)
    padded[:, :size] = anchors
    by_group = padded.reshape(count, groups, 8).transpose(1, 2, 0)
    sums = np.zeros((groups, 256, count), dtype=anchors.dtype)
    for bit in range(8):  # each bit doubles the subsets known so far
        sums[:, 1 << bit:2 << bit] = sums[:, :1 << bit] + by_group[:, bit, None]
    return sums


def inner_products(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products, rows x anchors, from subset sums and the rows' planes."""
    rows, count, groups = planes.shape
    total = np.zeros((rows, sums.shape[2]), dtype=sums.dtype)
    for plane in range(count - 1, -1, -1):  # the highest plane is the sign's and counts negative
        for group in range(groups):
            total += sums[group].take(planes[:, plane, group], axis=0)
        if plane == count - 1:
            np.negative(total, out=total)
        if plane:
            total += total
    return total


def _pack(planes: int):
    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            blobs: list = [b""] * len(lengths)
            starts = np.cumsum(lengths) - lengths
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                if length:
                    vectors = flat[starts[mine][:, None] + np.arange(length)]
                    for i, row in zip(mine.tolist(), planes_of(vectors, planes)):
                        blobs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(blobs, pa.binary())],
                ["vec_id", "label", "length", "planes"])
    return packed


class _Block:
    """Anchors of one length, and the scores in question for each of their searches."""

    def __init__(self, rows: list, length: int, planes: int):
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.labels = np.array([r["label"] for r in rows], dtype=np.int64)
        self.length, self.planes = length, planes
        vectors = [r["v"] for r in rows]
        # No partial sum of a shifted look-up goes beyond this.
        bound = max((sum(map(abs, v)) for v in vectors), default=0) << planes
        kind = np.int32 if bound < 2 ** 31 else np.int64 if bound < 2 ** 63 else object
        self.vectors = np.array(vectors, dtype=object).reshape(len(rows), length).astype(kind)
        # Searches: which anchor they belong to, and the scores they accept.
        self.owner = np.arange(len(rows))
        self.low = np.full(len(rows), -_LONG - 1, dtype=np.int64)
        self.high = np.full(len(rows), _LONG, dtype=np.int64)

    def asks(self, owner: list, low: list, high: list) -> None:
        order = np.argsort(np.array(owner, dtype=np.int64), kind="stable")
        self.owner, self.low, self.high = (np.array(x, dtype=np.int64)[order] for x in (owner, low, high))


def _first(search, ids, scores, k):
    """The first ``k`` rows of each search: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~scores, search))  # ~s falls as s rises, for every long
    search, ids, scores = search[order], ids[order], scores[order]
    start = np.flatnonzero(np.concatenate(([True], search[1:] != search[:-1])))
    place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
    keep = place < k
    return search[keep], ids[keep], scores[keep]


class _Found:
    """The best rows of each search so far."""

    def __init__(self, block: _Block, k: int):
        self.floor, self.k = block.low.copy(), k
        self.parts = [(np.zeros(0, dtype=np.int64),) * 3]
        self.held = self.kept = 0

    def add(self, search, ids, scores) -> None:
        if len(search):
            part = _first(search, ids, scores, self.k)
            self.parts.append(part)
            self.held += len(part[0])
            if self.held > 2 * self.kept + 10_000:
                self.merge()

    def merge(self):
        """Drop what cannot win, and raise the floors of searches that have enough."""
        search, ids, scores = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        if len(search):
            search, ids, scores = _first(search, ids, scores, self.k)
            last = np.flatnonzero(np.concatenate((search[1:] != search[:-1], [True])))
            full = last[np.diff(np.concatenate(([-1], last))) == self.k]
            self.floor[search[full]] = scores[full]
        self.parts, self.held, self.kept = [(search, ids, scores)], len(search), len(search)
        return self.parts[0]


def _pieces(batches: Iterable[pa.RecordBatch], block: _Block) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, labels and planes of rows of the block's length, few at first."""
    step = _ROWS[0]
    groups = -(-block.length // 8)
    for batch in batches:
        batch = batch.filter(pc.equal(batch.column(2), block.length))
        for a in range(0, len(batch), step):
            rows = batch.slice(a, step)
            planes = np.frombuffer(b"".join(rows.column(3).to_pylist()), dtype=np.uint8)
            yield (rows.column(0).to_numpy(), rows.column(1).to_numpy(),
                   planes.reshape(len(rows), block.planes, groups) if groups else
                   np.zeros((len(rows), block.planes, 0), dtype=np.uint8))
        step = _ROWS[1]


def _search(shared, k: int, own: bool):
    """Rows that each search of the block accepts, of the anchor's label or of others."""
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = _Found(block, k)
        # With ``own``, anchors meet rows of their label's bucket only; otherwise they meet all rows.
        sets = [np.flatnonzero(block.labels % _BUCKETS == b) for b in range(_BUCKETS)] if own else [
            np.arange(len(block.ids))]
        tiles = [(b, some[i:i + _TILE]) for b, some in enumerate(sets) for i in range(0, len(some), _TILE)]
        tables = {}
        for ids, labels, planes in _pieces(batches, block):
            for n, (bucket, anchors) in enumerate(tiles):
                mine = np.flatnonzero(labels % _BUCKETS == bucket) if own else slice(None)
                some, kinds, bits = ids[mine], labels[mine], planes[mine]
                # Searches of consecutive anchors are consecutive; an anchor may have none.
                a, b = np.searchsorted(block.owner, [anchors[0], anchors[-1] + 1])
                searches = np.arange(a, b)
                searches = searches[np.isin(block.owner[a:b], anchors)] if own else searches
                if not len(some) or not len(searches):
                    continue
                sums = tables.get(n)
                if sums is None:
                    sums = subset_sums(block.vectors[anchors])
                    if (len(tables) + 1) * sums.nbytes <= 64 << 20:
                        tables[n] = sums
                scores = inner_products(sums, bits)
                if scores.dtype == object:
                    scores = np.minimum(np.maximum(scores, -_LONG - 1), _LONG)
                scores = scores.astype(np.int64).T
                fits = (block.labels[anchors][:, None] == kinds[None, :]) == own
                fits &= block.ids[anchors][:, None] != some[None, :]
                at = np.searchsorted(anchors, block.owner[searches])
                for i in range(0, len(searches), _TILE):
                    part, row = searches[i:i + _TILE], at[i:i + _TILE]
                    values = scores[row]
                    good = fits[row] & (values >= best.floor[part, None]) & (values <= block.high[part, None])
                    s, c = np.nonzero(good)
                    best.add(part[s], some[c], values[s, c])
        search, ids, scores = best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(search), pa.array(ids), pa.array(scores)],
                                         ["search", "vec_id", "score"])
    return found


def _best(rows: DataFrame, block: _Block, k: int, own: bool) -> tuple[DataFrame, object]:
    """The first ``k`` rows of each search over all tasks, ranked from 1, and the broadcast it reads."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    found = rows.mapInArrow(_search(shared, k, own), "search long, vec_id long, score long")
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), shared


def mine(anchors: DataFrame, rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         share: tuple[int, int] = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Both sides have vec_id, label (long) and v (array of long).
    """
    spark = rows.sparkSession
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long")
    # As many planes as the longest component has bits, and one for the sign.
    end = F.greatest(F.max(F.array_max("v")), -(F.min(F.array_min("v")) + 1))
    widest = rows.agg(F.coalesce(end, F.lit(0)).alias("end")).first()["end"]
    planes = int(widest).bit_length() + 1
    packed = stored(rows.select("vec_id", "label", "v").mapInArrow(_pack(planes), _PACKED), "negatives-rows")
    asked = stored(anchors.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a"))
                   .select("vec_id", "a.label", "a.v", F.size("a.v").alias("length")), "negatives-anchors")
    done = []
    for length, count in sorted(map(tuple, asked.groupBy("length").count().collect())):
        blocks = -(-count * max(1, length) * 8 // BLOCK_BYTES)
        for number in range(blocks):
            own = (F.col("length") == length) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number)
            block = _Block(asked.where(own).orderBy("vec_id").collect(), length, planes)  # bounded by BLOCK_BYTES
            found, shared = _best(packed, block, positives, True)
            near = sorted(map(tuple, found.select("search", "rank", "vec_id", "score").collect()))
            shared.destroy()
            # Shares of a negative score leave nothing between them.
            near = [n for n in near if n[3] >= 0]
            block.asks([n[0] for n in near], [-(-share[0] * n[3] // 100) for n in near],
                       [share[1] * n[3] // 100 for n in near])
            if not near:
                continue
            found, shared = _best(packed, block, negatives, False)
            known = spark.createDataFrame(
                [(i, int(block.ids[n[0]]), n[2], n[3]) for i, n in enumerate(near)],
                "search long, anchor_id long, positive_id long, positive_score long")
            done.append(stored(found.join(F.broadcast(known), "search").select(
                "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score")), "negatives-found"))
            shared.destroy()
    out = spark.createDataFrame([], schema)
    for part in done:
        out = out.unionByName(part)
    return out


def with_moved_labels(rows: DataFrame) -> DataFrame:
    """Every seventh id takes the next of ten labels, so that near rows of another label exist."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
                           .otherwise(F.col("label")))
