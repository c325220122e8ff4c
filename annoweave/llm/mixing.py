"""Mixing sources to target weights, as a min-cost flow over membership patterns.

Documents that belong to the same set of sources form one pattern. A pattern can route its words
to any of its sources, up to their quotas; every further copy of its documents costs more than the
one before (convex repetition costs), so nothing is repeated while a first copy would do. The flow
is solved on the patterns, which are few; the documents are then chosen in Spark by a seeded draw.

Defined cases: a null or empty text has size 0; a null source is a source of its own and comes last;
an empty array of sources counts as the null source; repeated rows are separate documents; an empty
table gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from annoweave.llm.common import stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
SEED = 20
#: Patterns are solved on the driver. More than this many is an error, never a cut.
MAX_PATTERNS = 20_000
_BITS = 12  # of the draw, looked at per refinement
_LEVELS = 3
_TOP_UPS = 4


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> dict:
    """Words each source should give: ``share`` of all words by weight, at most ``most`` sizes.

    Weights repeat over the sources in code point order, null last. What a source cannot take is
    shared again among the others by weight until none is above its limit.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_ = share * sum(sizes.values()), list(order)
    found = {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not full:
            found.update({s: left * weight[s] / whole for s in open_})
            break
        found.update({s: float(most * sizes[s]) for s in full})
        left -= sum(found[s] for s in full)
        open_ = [s for s in open_ if s not in found]
    return found


def route(patterns: dict[tuple, int], quotas: dict, most: int = MAX_COPIES) -> dict[tuple, int]:
    """Words each pattern gives in a flow of most words at least cost.

    The cost of a word depends on the copy it is taken from only, so the cheapest flow fills the
    quotas copy by copy: a shortest augmenting path from a pattern's next copy, which may move words
    of other patterns between their sources on its way.
    """
    left = {s: int(q + 0.5) for s, q in quotas.items()}
    flow: dict[tuple, dict] = {p: dict.fromkeys(p, 0) for p in patterns}
    inside: dict = {}
    for p in patterns:
        for s in p:
            inside.setdefault(s, []).append(p)
    given = dict.fromkeys(patterns, 0)
    for _ in range(most):
        for start, size in patterns.items():
            room = size
            while room:
                came: dict = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, at = node = queue.popleft()
                    if kind == "s" and left[at] > 0:
                        end = node
                        break
                    steps = ([("s", s) for s in at] if kind == "p" else
                             [("p", p) for p in inside[at] if flow[p][at] > 0])
                    for step in steps:
                        if step not in came:
                            came[step] = node
                            queue.append(step)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                moved = min(room, left[end[1]])
                for (kind, a), (_, b) in zip(path, path[1:]):
                    if kind == "s":
                        moved = min(moved, flow[b][a])
                for (kind, a), (_, b) in zip(path, path[1:]):
                    if kind == "p":
                        flow[a][b] += moved
                    else:
                        flow[b][a] -= moved
                left[end[1]] -= moved
                room -= moved
                given[start] += moved
    return given


def _pattern(docs: DataFrame, sources: str) -> Column:
    kind = docs.schema[sources].dataType
    column = F.col(sources)
    if not isinstance(kind, T.ArrayType):
        return F.array(column.cast("string"))
    empty = column.isNull() | (F.size(column) <= 0)
    return F.when(empty, F.array(F.lit(None).cast("string"))).otherwise(
        F.sort_array(F.array_distinct(column.cast("array<string>")), asc=False))


def _digit(level: int) -> Column:
    return F.shiftrightunsigned(F.col("draw"), 60 - _BITS * (level + 1)).bitwiseAND(2 ** _BITS - 1)


def _cutoffs(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """For each pattern, the draw below which its documents have at most ``rest`` words.

    Sums by twelve bits of the draw name the range in which the words run out; that range alone is
    looked at again with the next twelve bits. Columns: pattern, cut, left (words still missing).
    """
    spark = rows.sparkSession
    cuts = rest.select("pattern", F.lit(0).cast("long").alias("cut"), F.col("rest").alias("left"))
    for level in range(_LEVELS):
        width = 60 - _BITS * level
        inside = (F.shiftrightunsigned("draw", width) == F.shiftrightunsigned("cut", width))
        sums = (rows.join(F.broadcast(cuts), "pattern").where(inside)
                .groupBy("pattern", "cut", "left", _digit(level).alias("digit"))
                .agg(F.sum("size").alias("words")))
        upto = Window.partitionBy("pattern").orderBy("digit")
        found = (sums.withColumn("reach", F.sum("words").over(upto))
                 .groupBy("pattern", "cut", "left")
                 .agg(F.min(F.when(F.col("reach") > F.col("left"), F.col("digit"))).alias("digit"),
                      F.max(F.when(F.col("reach") <= F.col("left"), F.col("reach"))).alias("taken")))
        step = F.lit(2 ** (60 - _BITS * (level + 1))).cast("long")
        # Without a digit at which the words run out, the rest of this range is taken whole.
        digit = F.coalesce("digit", F.lit(2 ** _BITS))
        found = found.select("pattern", (F.col("cut") + digit * step).alias("cut"),
                             (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"))
        cuts = spark.createDataFrame(found.collect(), cuts.schema)  # one row for each pattern
    return cuts


def _draw(seed: int) -> Column:
    """Sixty random bits, fixed by the seed and the document."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")).bitwiseAND(2 ** 60 - 1)


def _keyed(docs: DataFrame, sources: str, seed: int, *more: Column) -> DataFrame:
    return docs.select("doc_id", word_count("text").alias("size"),
                       _pattern(docs, sources).alias("pattern"), _draw(seed).alias("draw"), *more)


def _fill(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents that get one copy more than their pattern's base, as a small table of rules.

    Columns: pattern, cut (draws below it are in) and extra (single draws that are in as well).
    """
    spark = rows.sparkSession
    cuts = _cutoffs(rows, plan.where("rest > 0"))
    rules = {tuple(r["pattern"]): [r["cut"], r["left"], []] for r in cuts.collect()}
    schema = "pattern array<string>, cut long, left long, extra array<long>"
    for _ in range(_TOP_UPS):  # fill what is still open with the largest documents that fit
        table = spark.createDataFrame([(list(p), *r) for p, r in rules.items()], schema)
        fit = (rows.join(F.broadcast(table), "pattern")
               .where("draw >= cut and size > 0 and size <= left and not array_contains(extra, draw)")
               .groupBy("pattern").agg(F.max(F.struct("size", "draw")).alias("best")).collect())
        for found in fit:
            rule = rules[tuple(found["pattern"])]
            rule[1] -= found["best"]["size"]
            rule[2].append(found["best"]["draw"])
        if not fit:
            break
    return spark.createDataFrame([(list(p), *r) for p, r in rules.items()], schema).drop("left")


def _planned(docs: DataFrame, sources: str, weights, share: float, max_copies: int,
             seed: int) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of the documents and, for each pattern, what the flow decided."""
    spark = docs.sparkSession
    rows = stored(_keyed(docs, sources, seed), "mix-rows")
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): r["size"] for r in sums}
    sizes: dict = {}
    for pattern, size in patterns.items():
        for source in pattern:
            sizes[source] = sizes.get(source, 0) + size
    wanted = targets(sizes, weights, share, max_copies)
    given = route(patterns, wanted, max_copies)
    plan = [(list(p), size, given[p] // size if size else 1, given[p] % size if size else 0,
             [(s, float(sizes[s]), wanted[s]) for s in p]) for p, size in patterns.items()]
    plan = spark.createDataFrame(plan, "pattern array<string>, pattern_size long, base long, "
                                       "rest long, sources array<struct<source:string,size:double,"
                                       "target:double>>")
    return rows, plan.join(_fill(rows, plan), "pattern", "left")


def _copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    more = (F.col("draw") < F.col("cut")) | F.array_contains("extra", F.col("draw"))
    return (keyed.join(F.broadcast(plan), "pattern")
            .withColumn("copies", F.col("base") + F.coalesce(more, F.lit(False)).cast("long")))


def mix(docs: DataFrame, sources: str = "source", *, weights=WEIGHTS, share: float = SHARE,
        max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """How often each document enters the mix.

    ``sources`` names a text column, or an array column for documents of several sources. Returns
    one row for each document: doc_id, size, pattern, pattern_size, copies, and ``sources`` with
    the name, size and target of each of the document's sources.
    """
    rows, plan = _planned(docs, sources, weights, share, max_copies, seed)
    return _copies(rows, plan).select("doc_id", "size", "pattern", "pattern_size", "sources", "copies")


def mixed_rows(docs: DataFrame, sources: str = "source", *, weights=WEIGHTS, share: float = SHARE,
               max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns they came with."""
    _, plan = _planned(docs, sources, weights, share, max_copies, seed)
    keyed = _keyed(docs, sources, seed, F.struct(*docs.columns).alias("row"))
    every = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return (_copies(keyed, plan).where("copies > 0")
            .select("row", F.explode(every).alias("copy")).select("row.*"))
