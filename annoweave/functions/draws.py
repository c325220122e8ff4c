"""Reproducible draws: a hash of seed and row id stands in for a random number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 12


def draw(row_id: str, seed: int) -> Column:
    """Hex text whose order is a random permutation of the ids, fixed by ``seed``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def mark(share: Column | float) -> Column:
    """The hex text below which about ``share`` of all draws fall.

    Text compares in the order of the numbers it spells, so draws are compared
    with marks as they are. Nothing is below the mark of 0, all is below that of 1.
    """
    share = F.lit(share) if isinstance(share, float) else share
    digits = F.lower(F.hex((share * float(16 ** _DIGITS)).cast("bigint")))
    return (F.when(share <= 0, F.lit("")).when(share >= 1, F.lit("g"))
             .otherwise(F.lpad(digits, _DIGITS, "0")))
