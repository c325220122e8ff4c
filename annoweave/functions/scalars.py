"""Scalar expressions: cleaning, safe casts, guarded ratios, variant tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_name(name: Column | str) -> Column:
    """Lower-case identifier: runs of space, comma, hyphen or underscore become one underscore."""
    return F.btrim(F.regexp_replace(F.lower(_col(name)), "[ ,_-]+", "_"), F.lit("_"))


def term_uri(base: str, name: Column | str, prefix: str = "category") -> Column:
    return F.concat(F.lit(f"{base}{prefix}_"), clean_name(name))


def local_name(uri: Column | str) -> Column:
    """The text after the last ``#``, or the whole URI when there is none."""
    return F.substring_index(_col(uri), "#", -1)


def zero_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(0))


def flag(text: Column | str) -> Column:
    """Boolean from ``0``/``1``/``true``/``false`` text; anything else is NULL."""
    lowered = F.lower(_col(text).cast("string"))
    return (F.when(lowered.isin("1", "true"), F.lit(True))
             .when(lowered.isin("0", "false"), F.lit(False)))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole``, or 0 when ``whole`` is not positive."""
    part, whole = _col(part).cast("double"), _col(whole).cast("double")
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent_change(before: Column | str, after: Column | str) -> Column:
    """``(after - before) / before * 100``; NULL when ``before`` is zero."""
    before, after = _col(before).cast("double"), _col(after).cast("double")
    return F.try_divide(after - before, before) * 100


def variant_list(value: Column | str) -> Column:
    """The elements of a variant holding a JSON array; NULL for any other JSON type."""
    return F.try_variant_get(_col(value), "$", "array<variant>")


def variant_numbers(value: Column | str, kind: str, strict: bool) -> Column:
    """A variant holding a JSON array as an array of ``kind``; NULL for other JSON types.

    An element that is not numeric becomes NULL. Strict accepts JSON numbers and
    booleans; otherwise numeric text counts too. Only an array that mixes types,
    or holds text, is looked at element by element.
    """
    value = _col(value)
    numbers = F.try_variant_get(value, "$", f"array<{kind}>")
    if not strict:
        return numbers
    checked = F.transform(variant_list(unextracted(value)), lambda item: _strict_number(item, kind))
    return F.when(may_hold_text(value), checked).otherwise(numbers)


def variant_polygons(value: Column | str, strict: bool) -> Column:
    """A variant holding a list of lists of numbers as nested DOUBLE arrays.

    As ``variant_numbers``; a polygon that is not a list is NULL.
    """
    value = _col(value)
    numbers = F.try_variant_get(value, "$", "array<array<double>>")
    if not strict:
        return numbers
    checked = F.transform(variant_list(unextracted(value)), lambda polygon: F.transform(
        variant_list(polygon), lambda item: _strict_number(item, "double")))
    return F.when(may_hold_text(value), checked).otherwise(numbers)


def unextracted(value: Column | str) -> Column:
    """The same variant, whole, as an expression the Parquet scan does not look through.

    The scan extracts, for every row, each typed value a projection takes straight
    from a variant column. That is wanted for the usual case and not for a branch
    that few rows enter.
    """
    return F.try_variant_get(_col(value), "$", "variant")


def _strict_number(item: Column, kind: str) -> Column:
    return F.when(F.schema_of_variant(item) != "STRING", F.try_variant_get(item, "$", kind))


def may_hold_text(value: Column | str) -> Column:
    """Whether the types found in a variant include text, or a mix that may."""
    return F.schema_of_variant(unextracted(value)).rlike("STRING|VARIANT")


def whole_number(text: Column | str, kind: str = "bigint") -> Column:
    """Text of a number as an integer type; NULL if it is no number, not whole, or too large."""
    exact = _col(text).try_cast("decimal(38,9)")
    return F.when(exact == F.floor(exact), exact.try_cast(kind))


def whole_numbers(numbers: Column) -> Column:
    """An array of decimals as BIGINTs, NULL in place of those that are not whole."""
    return F.transform(numbers, lambda n: F.when(n == F.floor(n), n.try_cast("bigint")))
