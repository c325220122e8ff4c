"""Seeded sampling: uniform, proportional by stratum, and reference-keeping.

Rows are drawn by the order of a hash of seed and id; rows that share an id follow each other by a hash
of the whole row. So a sample depends on the seed and the rows only, never on partitioning or size, and
it always has exactly as many rows as asked for.

"The n lowest draws of each stratum" needs no sort: rows are counted by the first digits of their draw,
which names the digit at which a stratum's quota runs out, and the rows of that digit alone are counted
again by further digits. The rows below the end are then taken where they are, in one scan.

Summaries of at most LOCAL_ROWS rows (strata and their quotas, counts by digit, the draws around an end) are
worked out as plain rows, which costs one aggregate each; larger ones stay tables. Both give the same sample.

An id that is NULL is an error.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from annoweave.functions.draws import draw, mark
from annoweave.operators.joins import attach, keep_matching, keep_unmatched
from annoweave.schemas import TABLES
from annoweave.session import settle

# The documented gate and the small-mode sizes.
GATE_ROWS = 10_000
SMALL_IMAGES = 100
SMALL_ANNOTATIONS = 200

_DRAW = 12   # hex digits of the id's draw in a key; as many of the row's hash follow
_STEP = 3    # digits looked at per count
_FEW = 1000  # rows of a digit that are ranked as they are

#: A summary up to this many rows is worked out as plain rows.
LOCAL_ROWS = 100_000
# Values of these types compare and group as plain rows as they do in a table.
_PLAIN = (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.DecimalType)


@dataclass(frozen=True)
class Targets:
    """How many rows to keep of each kind."""

    images: int
    annotations: int

    def __post_init__(self):
        if self.images <= 0 or self.annotations <= 0:
            raise ValueError("a sample needs a positive size")

    @classmethod
    def of(cls, sample_size: int | None = None, small: bool = False) -> Targets:
        """The same size for both, or the small mode's sizes; one of them must be asked for."""
        if small:
            return cls(SMALL_IMAGES, SMALL_ANNOTATIONS)
        if sample_size is None:
            raise ValueError("a sample needs a size")
        return cls(sample_size, sample_size)


def gate_report(images: DataFrame, annotations: DataFrame, gate: int = GATE_ROWS) -> DataFrame:
    """Both counts, and whether either is strictly larger than the gate.

    A report only: whether a load samples is for its caller to say.
    """
    counts = (images.agg(F.count(F.lit(1)).alias("images"), F.lit(0).cast("bigint").alias("annotations"))
              .unionByName(annotations.agg(F.lit(0).cast("bigint").alias("images"),
                                           F.count(F.lit(1)).alias("annotations")))
              .agg(F.sum("images").alias("images"), F.sum("annotations").alias("annotations")))
    return counts.select("*", ((F.col("images") > gate) | (F.col("annotations") > gate)).alias("large"))


def _key(df: DataFrame, row_id: str, seed: int) -> Column:
    """Hex text that puts the rows in their drawn order."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.VariantType, T.MapType))]
    row = F.lpad(F.lower(F.hex(F.xxhash64(*plain).bitwiseAND(16 ** _DRAW - 1))), _DRAW, "0")
    return F.concat(F.substring(draw(row_id, seed), 1, _DRAW), row)


def _settled_keys(df: DataFrame, row_id: str, seed: int, *columns: str) -> DataFrame:
    """The drawn keys of all rows under the seed and the next one, with the given columns."""
    return settle(df.select(F.col(row_id).isNull().alias("_no_id"), _key(df, row_id, seed).alias("_key"),
                            *([_key(df, row_id, seed + 1).alias("_next")] if columns else []),
                            *[F.col(c) for c in dict.fromkeys(columns)]))


def _ends(keys: DataFrame, takes: DataFrame, stratum: str, strata: int) -> DataFrame:
    """The last key each stratum takes: stratum, ``_end``, and how many rows of that very key.

    ``takes`` has the strata with 0 < _take < _size. Every count but the first looks at one digit of each
    stratum only.
    """
    ends = takes.select(stratum, F.lit("").alias("_end"), F.col("_take").alias("_left"))
    for width in range(_STEP, 2 * _DRAW + 1, _STEP):
        inside = attach(keys, ends, stratum, at_most=strata).where(F.substring("_key", 1, width - _STEP) == F.col("_end"))
        counts = inside.groupBy(stratum, "_left", F.substring("_key", 1, width).alias("_digit")).agg(
            F.count(F.lit(1)).alias("_rows"))
        upto = F.sum("_rows").over(Window.partitionBy(stratum).orderBy("_digit"))
        ends = settle(counts.withColumn("_upto", upto)
                      .where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_rows") < F.col("_left")))
                      .select(stratum, F.col("_digit").alias("_end"), "_rows",
                              (F.col("_left") - F.col("_upto") + F.col("_rows")).alias("_left")))
        if (ends.agg(F.max("_rows")).first()[0] or 0) <= _FEW:
            break
        ends = ends.drop("_rows")
    few = attach(keys, ends.drop("_rows"), stratum, at_most=strata).where(F.col("_key").startswith(F.col("_end")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_key"))
    ranked = few.withColumn("_rank", rank)
    by_key = ranked.groupBy(stratum, "_key").agg(
        F.count_if(F.col("_rank") <= F.col("_left")).alias("_wanted"), F.count(F.lit(1)).alias("_there"))
    last = F.max_by(F.struct(F.col("_key").alias("_end"), "_wanted", "_there"), "_key")
    return settle(by_key.where("_wanted > 0").groupBy(stratum).agg(last.alias("_last")).select(stratum, "_last.*"))


def _marked(df: DataFrame, quotas: DataFrame, stratum: str, row_id: str, seed: int,
            keys: DataFrame) -> DataFrame:
    """``df`` with ``_in``: whether a row is among the ``take`` lowest draws of its stratum."""
    part = settle(quotas.select(stratum, F.col("size").alias("_size"), F.col("take").alias("_take")))
    strata = part.count()
    ends = _ends(keys, part.where("_take > 0 and _take < _size"), stratum, strata)
    rules = _beside(part, ends, stratum)
    drawn = df.withColumn("_key", _key(df, row_id, seed))
    if stratum not in df.columns:  # all rows are one stratum
        drawn = drawn.withColumn(stratum, F.lit(0))
    drawn = attach(drawn, rules, stratum, at_most=strata)
    return _within(drawn, stratum, not ends.where("_wanted < _there").isEmpty()).select(*df.columns, "_in")


def _within(drawn: DataFrame, stratum: str, tied: bool) -> DataFrame:
    """``drawn``, rows beside the rule of their stratum, with ``_in``.

    ``tied``: somewhere a quota ends among equal rows, of which it takes only so many.
    """
    whole = (F.col("_take") >= F.col("_size")) | (F.coalesce(F.col("_key") <= F.col("_end"), F.lit(False)))
    if not tied:
        return drawn.withColumn("_in", whole)
    cut = F.coalesce((F.col("_key") == F.col("_end")) & (F.col("_wanted") < F.col("_there")), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(stratum, "_key").orderBy("_wanted"))
    equal = drawn.where(cut).withColumn("_rank", rank).withColumn("_in", F.col("_rank") <= F.col("_wanted"))
    return drawn.where(~cut).withColumn("_in", whole).unionByName(equal.drop("_rank"))


def _beside(part: DataFrame, ends: DataFrame, stratum: str) -> DataFrame:
    """The ends of the strata that have one, beside all strata."""
    side = ends.withColumnRenamed(stratum, "_stratum")
    return part.join(side, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").drop("_stratum")


def _listed(df: DataFrame) -> list[tuple] | None:
    """The rows of a summary, or None if there are more than LOCAL_ROWS."""
    rows = df.limit(LOCAL_ROWS + 1).toArrow()
    if rows.num_rows > LOCAL_ROWS:
        return None
    return list(zip(*(c.to_pylist() for c in rows.columns)))


def _plain(keys: DataFrame, *columns: str) -> bool:
    return all(isinstance(keys.schema[c].dataType, _PLAIN) for c in columns)


def _nulls_first(value) -> tuple:
    return (value is not None, value)


@dataclass(frozen=True)
class _Rule:
    """What a stratum takes: all rows up to a last key, and of that very key so many of those there are."""

    size: int
    take: int
    end: str | None = None
    wanted: int | None = None
    there: int | None = None


def _granted(sizes: list[tuple], size: int) -> dict:
    """stratum -> rule without an end, from rows of stratum, size and first position; see ``allocate``."""
    total, left, rules = sum(n for _, n, _ in sizes), size, {}
    for stratum, n, _ in sorted(sizes, key=lambda s: (_nulls_first(s[2]), _nulls_first(s[0]))):
        take = n if total <= size else min(max(1, n * size // total), left)
        rules[stratum] = _Rule(n, take)
        left -= take
    return rules


def _local(rows: DataFrame, stratum: str, names: list[str], side: list[tuple]) -> DataFrame:
    """Plain rows as a table: ``_lookup`` of the stratum's type, then the named keys and numbers."""
    schema = T.StructType([T.StructField("_lookup", rows.schema[stratum].dataType)]
                          + [T.StructField(n, T.StringType() if n in ("_end", "_start") else T.LongType())
                             for n in names])
    arrow = to_arrow_schema(schema)
    columns = list(zip(*side)) if side else [()] * len(arrow)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return rows.sparkSession.createDataFrame(table, schema)


def _beside_local(rows: DataFrame, stratum: str, names: list[str], side: list[tuple]) -> DataFrame:
    """``rows`` beside the plain rows of their strata; other strata go."""
    local = F.broadcast(_local(rows, stratum, names, side))
    return rows.join(local, F.col(stratum).eqNullSafe(F.col("_lookup"))).drop("_lookup")


def _local_ends(keys: DataFrame, rules: dict, stratum: str) -> dict | None:
    """The rules with their ends, or None if some step is too large for plain rows."""
    open_ = {s: ("", r.take, r.size) for s, r in rules.items() if 0 < r.take < r.size}
    width = 0
    while True:
        near = keys
        if width:
            near = _beside_local(keys, stratum, ["_start"], [(s, start) for s, (start, _, _) in open_.items()])
            near = near.where(F.substring("_key", 1, width) == F.col("_start")).drop("_start")
        elif len(open_) < len(rules):
            near = _beside_local(keys, stratum, [], [(s,) for s in open_])
        last = sum(rows for _, _, rows in open_.values()) <= LOCAL_ROWS
        if not last:
            steps = [w for w in range(1, 5) if len(open_) * 16 ** w <= LOCAL_ROWS]
            if not steps or width + steps[-1] > 2 * _DRAW:
                return None
            width += steps[-1]
        digits = F.col("_key") if last else F.substring("_key", 1, width)
        found = _listed(near.groupBy(stratum, digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_rows")))
        if found is None:
            return None
        found.sort(key=lambda row: (_nulls_first(row[0]), row[1]))
        for name, group in groupby(found, key=lambda row: row[0]):
            _, left, _ = open_[name]
            for _, start, rows in group:
                if rows >= left:
                    open_[name] = (start, left, rows)
                    break
                left -= rows
        if last:
            return rules | {s: _Rule(rules[s].size, rules[s].take, end, wanted, there)
                            for s, (end, wanted, there) in open_.items()}


def _ruled(drawn: DataFrame, rules: dict, stratum: str) -> DataFrame:
    side = [(s, r.size, r.take, r.end, r.wanted, r.there) for s, r in rules.items()]
    marked = _beside_local(drawn, stratum, ["_size", "_take", "_end", "_wanted", "_there"], side)
    tied = any(r.end is not None and r.wanted < r.there for r in rules.values())
    return _within(marked, stratum, tied)


def _refuse(missing: int | None, row_id: str) -> None:
    if missing:
        raise ValueError(f"rows without {row_id} cannot be drawn")


def _local_sample(df: DataFrame, keys: DataFrame, size: int, stratum: str, order: str, row_id: str,
                  seed: int) -> DataFrame | None:
    """The sample by plain summaries, or None where one of them is too large.

    ``keys`` has the rows' strata, positions and draws under both seeds, ``_all`` being the one stratum of a
    uniform sample and of the top-up.
    """
    found = _listed(keys.groupBy(stratum).agg(F.count(F.lit(1)), F.min(order), F.count_if("_no_id")))
    if found is None:
        return None
    _refuse(sum(row[3] for row in found), row_id)
    rules = _local_ends(keys, _granted([row[:3] for row in found], size), stratum)
    if rules is None:
        return None
    drawn = df.withColumns({"_key": _key(df, row_id, seed), "_next": _key(df, row_id, seed + 1), "_all": F.lit(0)})
    total, granted = sum(r.size for r in rules.values()), sum(r.take for r in rules.values())
    spare = min(size, total) - granted
    columns = [F.col(c) for c in df.columns]
    if spare <= 0:
        return _ruled(drawn, rules, stratum).where("_in").select(*columns)
    # A top-up takes the lowest draws under the second seed of what the quotas left. It has at most one row
    # for each stratum, so a mark somewhat above its share of the rest leaves few rows to look at.
    rest = _ruled(keys, rules, stratum).where(~F.col("_in")).select("_all", F.col("_next").alias("_key"))
    share = min(1.0, (2.0 * spare + 50) / (total - granted))
    near = _listed(rest.where(F.col("_key") < mark(share)).groupBy("_key").agg(F.count(F.lit(1))))
    if near is None or sum(n for _, n in near) < spare:
        more = _local_ends(rest, {0: _Rule(total - granted, spare)}, "_all")
        if more is None:
            return None
        top = more[0]
    else:
        left, top = spare, None
        for key, rows in sorted(near):
            if rows >= left:
                top = _Rule(total - granted, spare, key, left, rows)
                break
            left -= rows
    first = _ruled(drawn, rules, stratum)
    if top.end is None:
        return first.select(*columns)
    if top.wanted == top.there:
        return first.where(F.col("_in") | (F.col("_next") <= top.end)).select(*columns)
    left_over = first.where(~F.col("_in")).select(*df.columns, "_all", F.col("_next").alias("_key"))
    return (first.where("_in").select(*columns)
            .unionByName(_ruled(left_over, {0: top}, "_all").where("_in").select(*columns)))


def uniform_sample(df: DataFrame, size: int, *, row_id: str = "id", seed: int = 42) -> DataFrame:
    """Exactly ``min(size, rows)`` rows: those with the lowest draws."""
    if size <= 0:
        return df.limit(0)
    keys = _settled_keys(df, row_id, seed).withColumn("_all", F.lit(0))
    sample = _local_sample(df, keys, size, "_all", "_all", row_id, seed)
    if sample is not None:
        return sample
    _refuse(keys.where("_no_id").limit(1).count(), row_id)
    quotas = keys.groupBy("_all").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "take", F.least(F.col("size"), F.lit(size)))
    return _marked(df, quotas, "_all", row_id, seed, keys).where("_in").select(*df.columns)


def strata_sizes(df: DataFrame, stratum: str, order: str) -> DataFrame:
    """Rows and first position of every stratum; NULL is a stratum of its own."""
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))


def running_total(df: DataFrame, order: Collection[str], value: str) -> DataFrame:
    """``df`` with ``_before``, the sum of ``value`` over the rows before each in the given order.

    Rows are dealt to ranges and summed there; one number per range says what lies before it.
    """
    dealt = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.join(F.broadcast(parts), "_part")
            .withColumn("_before", F.col("_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_part", "_ahead"))


def allocate(strata: DataFrame, stratum: str, size: int, total: int) -> DataFrame:
    """Proportional quotas, at least one each, granted in order of first appearance."""
    share = F.expr(f"cast(greatest(1, cast(size as decimal(20,0)) * {size} div {max(total, 1)}) as bigint)")
    shared = running_total(strata.withColumn("share", share), ("first", stratum), "share")
    grant = F.greatest(F.lit(0), F.least(F.col("share"), F.lit(size) - F.col("_before"))).cast("bigint")
    return shared.withColumn("take", grant).drop("share", "_before")


def _quotas(keys: DataFrame, stratum: str, order: str, size: int) -> DataFrame:
    if _plain(keys, stratum, order):
        found = _listed(strata_sizes(keys, stratum, order))
        if found is not None:
            side = [(s, r.size, r.take) for s, r in _granted(found, size).items()]
            return _local(keys, stratum, ["size", "take"], side).withColumnRenamed("_lookup", stratum)
    strata = settle(strata_sizes(keys, stratum, order))
    total = strata.agg(F.sum("size")).first()[0] or 0
    if total <= size:
        return strata.withColumn("take", F.col("size"))
    return settle(allocate(strata, stratum, size, total))


def stratum_quotas(df: DataFrame, size: int, *, stratum: str, order: str) -> DataFrame:
    """The quota report: every stratum with its size and its allocated rows."""
    return _quotas(df, stratum, order, size).select(stratum, "size", "take")


def stratified_sample(df: DataFrame, size: int, *, stratum: str, row_id: str = "id",
                      order: str | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``min(size, rows)`` rows, proportional by stratum.

    Each stratum gets ``max(1, floor(rows_in_stratum * size / rows))`` while the
    budget lasts, in order of first appearance (by ``order``, the id by default).
    Slots left over go to the lowest draws, under a second seed, of what remains.
    """
    if size <= 0:
        return df.limit(0)
    keys = _settled_keys(df, row_id, seed, stratum, order or row_id)
    if _plain(keys, stratum, order or row_id):
        sample = _local_sample(df, keys.withColumn("_all", F.lit(0)), size, stratum, order or row_id, row_id, seed)
        if sample is not None:
            return sample
    _refuse(keys.where("_no_id").limit(1).count(), row_id)
    quotas = _quotas(keys, stratum, order or row_id, size)
    granted, total = quotas.agg(F.coalesce(F.sum("take"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    marked = _marked(df, quotas, stratum, row_id, seed, keys)
    chosen = marked.where("_in").select(*df.columns)
    spare = min(size, total) - granted
    if spare <= 0:
        return chosen
    rest = marked.where(~F.col("_in")).select(*df.columns)
    return chosen.unionByName(uniform_sample(rest, spare, row_id=row_id, seed=seed + 1))


def unsampled(df: DataFrame, sample: DataFrame, *, row_id: str = "id",
              at_most: int | None = None) -> DataFrame:
    """The rows of ``df`` whose id is not in ``sample``."""
    return keep_unmatched(df, sample, row_id, row_id, at_most=at_most)


def sample_children(children: DataFrame, parents: DataFrame, size: int, *, parent_key: str,
                    parent_id: str = "id", row_id: str = "id", stratum: str | None = None,
                    order: str | None = None, seed: int = 42,
                    at_most_parents: int | None = None) -> DataFrame:
    """Sample the children of the given parents, by stratum or uniformly."""
    related = keep_matching(children, parents, parent_key, parent_id, at_most=at_most_parents)
    if stratum is None:
        return uniform_sample(related, size, row_id=row_id, seed=seed)
    return stratified_sample(related, size, stratum=stratum, row_id=row_id, order=order, seed=seed)


@dataclass(frozen=True)
class Keys:
    """Column names of the sampled pair of tables."""

    image_id: str = "id"
    image_stratum: str = "license"
    image_order: str | None = None
    annotation_id: str = "id"
    annotation_image: str = "image_id"
    annotation_stratum: str = "category_id"
    annotation_order: str | None = None


def _drawn(df: DataFrame, size: int, by_stratum: bool, stratum: str, row_id: str, order: str | None,
           seed: int) -> DataFrame:
    if by_stratum:
        return stratified_sample(df, size, stratum=stratum, row_id=row_id, order=order, seed=seed)
    return uniform_sample(df, size, row_id=row_id, seed=seed)


def referential_sample(images: DataFrame, annotations: DataFrame, targets: Targets, *,
                       keys: Keys = Keys(), method: str = "stratified", seed: int = 42,
                       all_images: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sampled images, and sampled annotations of those images only.

    ``method`` is ``stratified`` or ``uniform``. With ``all_images`` the images are kept whole and
    annotations are sampled directly.
    """
    if method not in ("stratified", "uniform"):
        raise ValueError(f"unknown sampling method: {method}")
    by_stratum = method == "stratified"
    related, kept = annotations, images
    if not all_images:
        kept = _drawn(images, targets.images, by_stratum, keys.image_stratum, keys.image_id,
                      keys.image_order, seed)
        parents = settle(kept.select(keys.image_id))
        related = keep_matching(annotations, parents, keys.annotation_image, keys.image_id)
    return kept, _drawn(related, targets.annotations, by_stratum, keys.annotation_stratum,
                        keys.annotation_id, keys.annotation_order, seed)


def sample_dataset(tables: Mapping[str, DataFrame], targets: Targets, *,
                   wanted: Collection[str] = TABLES, **options) -> dict[str, DataFrame]:
    """The ``wanted`` tables of a referential sample.

    The metadata tables stay whole; links and points follow the sampled annotations.
    """
    images, annotations = referential_sample(tables["images"], tables["annotations"],
                                             targets, **options)
    cut = {name: tables[name] for name in wanted if name in tables}
    cut.update({n: df for n, df in (("images", images), ("annotations", annotations)) if n in cut})
    followers = [n for n in ("annotation_attributes", "segmentations") if n in cut]
    if followers:
        picked = settle(annotations.select("id"))
        for name in followers:
            cut[name] = keep_matching(tables[name], picked, "annotation_id", "id")
    return cut
