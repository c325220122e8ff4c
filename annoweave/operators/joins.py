"""Joins on key lists: settled once, broadcast when few, split by adaptive execution otherwise.

The keys are computed once (settled and counted), so neither side is evaluated twice. Beyond the
broadcast bound both sides are sorted and merged; adaptive execution splits the tasks of hot and of NULL
keys on the left side and repeats the few key rows they meet. Before a semi join of that kind a Bloom filter
of the keys, which is far smaller than they are, is tested where the left side is read: rows that match
nothing are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.session import settle

# A key list up to this many rows is broadcast; beyond it both sides shuffle.
BROADCAST_ROWS = 500_000

# A Bloom filter has blocks of so many bits; a key sets four bits of one block.
_BLOCK_BITS = 1 << 15
_WORDS = _BLOCK_BITS // 64
BITS_PER_KEY = 10
#: The most a filter may take when it is broadcast. Beyond it keys get fewer bits each.
BLOOM_BYTES = 32 << 20
#: So many keys are no larger than one block; a filter of fewer saves nothing.
_FEWEST_KEYS = _BLOCK_BITS // 128
#: With fewer bits a key than this a filter lets nearly all rows through, and is left out.
_FEWEST_BITS = 4


def _side(df: DataFrame, at_most: int | None) -> DataFrame:
    """``df``, to be broadcast if it is small: by a bound the caller can prove, or by count."""
    if at_most is not None and at_most <= BROADCAST_ROWS:
        return F.broadcast(df)
    settled = settle(df)
    return F.broadcast(settled) if settled.count() <= BROADCAST_ROWS else settled


def _lookup(right: DataFrame, right_key: str) -> DataFrame:
    return right.select(F.col(right_key).alias("_lookup")).where("_lookup is not null").distinct()


def _keys(right: DataFrame, right_key: str, at_most: int | None) -> DataFrame:
    return _side(_lookup(right, right_key), at_most)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """Four places in a block, fifteen bits of a second hash each."""
    mixed = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(_BLOCK_BITS - 1) for i in range(4)]


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The blocks of a Bloom filter: block, and words, its bits in 64-bit words.

    Words are put together by partial bit-wise sums in one aggregate; the second only lines up the at most 512
    words of a block.
    """
    key = F.col(column)
    places = keys.select(_block(key, blocks).alias("block"), F.explode(F.array(*_bits(key))).alias("bit"))
    words = places.groupBy("block", F.expr("cast(bit div 64 as int)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    lined = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("masks"))
    return lined.select("block", F.expr(
        f"transform(sequence(0, {_WORDS - 1}), i -> coalesce(try_element_at(masks, i), 0L))").alias("words"))


def may_match(left: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``left`` whose key the filter may hold: all that it holds and few others. NULL is not held."""
    block = bloom.select(F.col("block").alias("_bloom_block"), F.col("words").alias("_bloom_words"))
    found = left.join(F.broadcast(block), _block(F.col(key), blocks) == F.col("_bloom_block"))
    there = F.col(key).isNotNull()
    for bit in _bits(F.col(key)):
        word = F.get("_bloom_words", F.shiftright(bit, 6).cast("int"))
        there = there & (F.getbit(word, (bit % 64).cast("int")) == 1)
    return found.where(there).drop("_bloom_block", "_bloom_words")


def _prefiltered(left: DataFrame, left_key: str, keys: DataFrame, count: int) -> DataFrame:
    blocks = max(1, min(count * BITS_PER_KEY, BLOOM_BYTES * 8) // _BLOCK_BITS)
    if count < _FEWEST_KEYS or blocks * _BLOCK_BITS < count * _FEWEST_BITS:
        return left
    return may_match(left, left_key, settle(bloom_filter(keys, "_lookup", blocks)), blocks)


def keep_matching(left: DataFrame, right: DataFrame, left_key: str, right_key: str = "id", *,
                  at_most: int | None = None, broadcast_rows: int | None = None) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right`` (left semi join)."""
    keys = _lookup(right, right_key)
    bound = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if at_most is not None and at_most <= bound:
        keys = F.broadcast(keys)
    else:
        keys = settle(keys)
        count = keys.count()
        if count <= bound:
            keys = F.broadcast(keys)
        else:
            left = _prefiltered(left, left_key, keys, count)
    return left.join(keys, F.col(left_key) == F.col("_lookup"), "left_semi")


def keep_unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str = "id", *,
                   at_most: int | None = None) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right`` (left anti join); NULL occurs nowhere."""
    keys = _keys(right, right_key, at_most)
    return left.join(keys, F.col(left_key) == F.col("_lookup"), "left_anti")


def attach(left: DataFrame, lookup: DataFrame, key: str, *, at_most: int | None = None) -> DataFrame:
    """Add the columns of ``lookup`` (one row per key, NULL included) to matching rows."""
    side = _side(lookup.withColumnRenamed(key, "_lookup"), at_most)
    return left.join(side, F.col(key).eqNullSafe(F.col("_lookup"))).drop("_lookup")
