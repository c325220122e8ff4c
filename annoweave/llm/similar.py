"""N-gram Jaccard join: which documents share nearly all of their word shingles.

Two sets link when ``100 * common >= percent * united``. Under any one order of all shingles, linked
sets share a shingle among the first few of each (prefix filter), and the first one they share stands
early enough in both that the rest can still hold what is missing (positional filter). Candidates come
from one order and must pass the same test under the other orders before their sets are compared. All
orders put shingles that occur in many documents last, the most frequent ones at the very end.

Documents with equal sets form a class and are compared once, by their smallest id. Where many documents
share a shingle, each is compared with the one in which it stands first; then those that are not
connected with that one are compared with the others. So ``join_similar`` does not spell out the pairs
inside a component, and loses no link between components. ``exact_links`` and ``count_links`` verify every
candidate pair of classes instead: their work grows with the pairs of a group, which is the size of their
result where most of them link.

Defined cases: a null or empty text has no shingles and no links; rows without a doc_id take part like
others, those of one text as one document, and where no document of a component has an id the component
has none; rows that share a doc_id are one document with the links of each. An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.llm.common import stored, text_batches
from annoweave.llm.components import components
from annoweave.llm.shingles import mix, shingle_sets
from annoweave.operators.joins import keep_matching, keep_unmatched
from annoweave.session import release

#: A shingle in more documents than this is frequent, and larger groups are not paired in full.
FREQUENT = 32
#: Frequent shingles shipped to every task, the most frequent first: 9 bytes each. The list only
#: shapes the orders; any list gives the same links.
SHIPPED = 1 << 20
ORDERS = 3
_ROWS = 512  # documents whose whole sets a task holds at once
_HELD = 1 << 20  # shingles a task gathers before it writes them out
_VALUE_BITS = 32
_BLOBS = 200  # rows of packed hashes, or whole texts, in an Arrow batch while shingles are counted
#: Rows of a block of a large group; a task of the exact mode pairs two blocks.
BLOCK = 1024


def _range_bits(spark) -> int:
    """Ranges of shingle hashes to count in, so that each is a small part of a partition."""
    return max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of the hashes of frequent shingles, sorted, and a class that grows with their count.

    Tasks send the hashes of each range as sorted arrays of their next 32 bits, a quarter of what rows
    of hash and count would take.
    """
    spark = docs.sparkSession
    bits = _range_bits(spark)
    shift = np.uint64(64 - bits - _VALUE_BITS)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            values = np.sort(np.concatenate(held)) >> shift
            ranges = (values >> np.uint64(_VALUE_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            parts = np.split(values.astype(np.uint32), cuts)
            names = ranges[np.concatenate(([0], cuts))]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["part", "hashes"])

        for batch in batches:
            for found in shingle_sets(batch.column(0), width):
                if len(found):
                    held.append(found)
                    size += len(found)
                if size > _HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > FREQUENT
            keys = (np.uint64(now) << np.uint64(_VALUE_BITS)) | values[often].astype(np.uint64)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(counts[often])], ["key", "n"])

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now and held:
                    yield out()
                    held = []
                now = part
                held.append(np.frombuffer(blob.as_buffer(), dtype=np.uint32))
        if held:
            yield out()

    ranges = docs.select("text").mapInArrow(gather, "part int, hashes binary")
    # A row of hashes may take tens of kilobytes, so they too go to Python few at a time.
    with text_batches(spark, _BLOBS):
        stored_counts = stored(ranges.repartition("part").sortWithinPartitions("part")
                               .mapInArrow(count, "key long, n long"), "similar-frequent")
    counted = stored_counts.withColumn("class", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    # Whole classes, from the most frequent down, as far as the bound allows.
    sizes = {r["class"]: r["count"] for r in counted.groupBy("class").count().collect()}
    least, room = 64, SHIPPED
    for kind in sorted(sizes, reverse=True):
        room -= sizes[kind]
        if room < 0:
            break
        least = kind
    top = counted.where(F.col("class") >= least).select("key", "class").toArrow()
    keys = top.column("key").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    release(stored_counts)
    return keys[order], top.column("class").to_numpy().astype(np.uint8)[order]


def _ordered(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], shift: int, order: int,
             most: int) -> np.ndarray:
    """The first ``most`` shingles of a set under one of the orders."""
    keys, classes = frequent
    place = found if order == 0 else mix(found + np.uint64(order * 0x9E3779B97F4A7C15 % 2 ** 64))
    rank = np.zeros(len(found), dtype=np.uint8)
    if len(keys):
        head = found >> np.uint64(shift)
        at = np.minimum(np.searchsorted(keys, head), len(keys) - 1)
        rank = np.where(keys[at] == head, classes[at], 0).astype(np.uint8)
    if order == 0 and not rank.any():
        return found[:most]  # sets come sorted
    return found[np.lexsort((place, rank))[:most]]


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text, rows without an id under one of their text, above any usual id."""
    of_text = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND((1 << 62) - 1)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), of_text).alias("doc_id"), "text",
                       F.col("doc_id").isNotNull().alias("named"))


def _prefixes(docs: DataFrame, shared, width: int, percent: int) -> DataFrame:
    """doc_id, named, n, digest of the set (null without shingles) and its prefix under the first order."""
    shift = 64 - _range_bits(docs.sparkSession) - _VALUE_BITS

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            sizes, digests, first = [], [], []
            for found in shingle_sets(batch.column(1), width):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                first.append(_ordered(found, often, shift, 0, prefix_length(len(found), percent)).view(np.int64))
            ends = np.cumsum([0] + [len(f) for f in first])
            flat = np.concatenate(first) if first else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "named", "n", "digest", "first"])

    return _keyed(docs).mapInArrow(
        work, "doc_id long, named boolean, n long, digest binary, first array<long>")


def _may_link(na, pa_, nb, pb, percent: int):
    """Sizes near enough, and enough left behind the first common shingle, at these places."""
    least = np.minimum(na - pa_, nb - pb) * (100 + percent)
    return (percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)) & (least >= percent * (na + nb))


def _paired(percent: int):
    """Pairs of the documents of each shingle, from rows sorted by shingle and place.

    Rows of groups up to FREQUENT are paired in full. A larger group gives the pairs with its first
    row, and its rows, for what is left to compare. A group is never held as a whole.
    """
    names = ["token", "a", "b", "n", "place"]

    def batch_of(token, a, b, n, place):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (token, a, b, n, place)], names)

    def pairs(token, doc, n, place, small):
        out_a, out_b = [], []
        for step in range(1, FREQUENT):
            if step >= len(token):
                break
            i = np.flatnonzero((token[:-step] == token[step:]) & small[:-step])
            j = i + step
            good = _may_link(n[i], place[i], n[j], place[j], percent) & (doc[i] != doc[j])
            out_a.append(np.minimum(doc[i], doc[j])[good])
            out_b.append(np.maximum(doc[i], doc[j])[good])
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (doc[:0], doc[:0])

    def star(head, token, doc, n, place):
        """Rows of one large group whose first row is ``head``: the pairs with it, then the rows."""
        good = _may_link(head[2], head[3], n, place, percent) & (doc != head[1])
        a = np.minimum(doc, head[1])[good]
        yield batch_of(np.ma.masked_all(len(a), np.int64), a, np.maximum(doc, head[1])[good],
                       np.ma.masked_all(len(a), np.int64), np.ma.masked_all(len(a), np.int64))
        yield batch_of(token, np.full(len(doc), head[1]), doc, n, place)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, dtype=np.int64)] * 4
        head = None  # first row of the large group that is still open

        def finished(columns):
            token = columns[0]
            cuts = np.flatnonzero(np.diff(token)) + 1
            bounds = np.concatenate(([0], cuts, [len(token)])) if len(token) else np.zeros(1, dtype=int)
            sizes = np.diff(bounds)
            small = np.repeat(sizes <= FREQUENT, sizes)
            a, b = pairs(*columns, small)
            none = np.ma.masked_all(len(a), np.int64)
            yield batch_of(none, a, b, none, none)
            for at in np.flatnonzero(sizes > FREQUENT):
                rows = [c[bounds[at]:bounds[at + 1]] for c in columns]
                yield from star([c[0] for c in rows], *rows)

        for batch in batches:
            columns = [np.concatenate((c, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)))
                       for i, c in enumerate(carry)]
            if head is not None:
                to = int(np.searchsorted(columns[0] != head[0], True)) if columns[0][-1] != head[0] else len(columns[0])
                yield from star(head, *[c[:to] for c in columns])
                columns = [c[to:] for c in columns]
                if not len(columns[0]):
                    carry = columns
                    continue
                head = None
            if not len(columns[0]):
                continue
            open_ = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
            yield from finished([c[:open_] for c in columns])
            carry = [c[open_:] for c in columns]
            if len(carry[0]) > FREQUENT:
                head = [c[0] for c in carry]
                yield from star(head, *carry)
                carry = [c[:0] for c in carry]
        if head is None:
            yield from finished(carry)

    return work


def _sets_of(docs: DataFrame, ids: DataFrame, width: int, columns: list[str], parts) -> DataFrame:
    """doc, n, and for each of ``columns`` a list of ``parts`` of the whole set, for the given ids."""
    def lists(found: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0] + [len(f) for f in found])
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(at, _ROWS)
                sets = list(shingle_sets(piece.column(1), width))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(s) for s in sets], pa.int64())]
                    + [lists(part) for part in parts(sets)], ["doc", "n", *columns])

    chosen = keep_matching(_keyed(docs).drop("named"), ids, "doc_id", "doc")
    return chosen.mapInArrow(work, ", ".join(["doc long, n long", *[f"{c} array<long>" for c in columns]]))


def _other_orders(docs: DataFrame, ids: DataFrame, shared, width: int, percent: int) -> DataFrame:
    """doc, n and the set's prefixes under the other orders, for the given ids."""
    shift = 64 - _range_bits(docs.sparkSession) - _VALUE_BITS
    orders = range(1, ORDERS)

    def prefixes(sets: list[np.ndarray]) -> list[list[np.ndarray]]:
        often = shared.value
        return [[_ordered(s, often, shift, k, prefix_length(len(s), percent)) for s in sets] for k in orders]

    return _sets_of(docs, ids, width, [f"p{k}" for k in orders], prefixes)


def _passes(order: int, percent: int) -> Column:
    """The prefix and positional test of a pair under one of the other orders."""
    first = F.get(F.array_intersect(f"a_p{order}", f"b_p{order}"), F.lit(0))
    left = F.least(F.col("a_n") - F.array_position(f"a_p{order}", first) + 1,
                   F.col("b_n") - F.array_position(f"b_p{order}", first) + 1)
    return F.coalesce(left * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n")), F.lit(False))


def _side(sets: DataFrame, name: str) -> DataFrame:
    return sets.select(F.col("doc").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in sets.columns if c != "doc"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc"))


def _links(docs: DataFrame, pairs: DataFrame, orders: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs a, b that pass every other order and whose sets are alike enough.

    Whole sets are made again, of the documents of pairs that have passed the orders: few of those that
    the first order brings together, and several times the size of the prefixes.
    """
    both = pairs.join(_side(orders, "a"), "a").join(_side(orders, "b"), "b")
    for k in range(1, ORDERS):
        both = both.where(_passes(k, percent))
    left = stored(both.select("a", "b").distinct(), "similar-candidates")
    with text_batches(docs.sparkSession):
        sets = stored(_sets_of(docs, _ends(left), width, ["whole"], lambda sets: [sets]), "similar-sets")
    whole = left.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    common = F.size(F.array_intersect("a_whole", "b_whole"))
    alike = 100 * common >= percent * (F.col("a_n") + F.col("b_n") - common)
    links = stored(whole.where(alike).select("a", "b").distinct(), "similar-links")
    release(left, sets)
    return links


def _remaining(members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of a large group that may link and are not in one component yet.

    A pair has a row outside the component of the group's first row, so only those rows are joined
    with the rest of their group.
    """
    def of(column: str) -> DataFrame:
        return roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))

    rows = (members.join(of("b"), "b", "left").join(of("a"), "a", "left")
            .select("token", F.col("b").alias("doc"), "n", "place",
                    F.coalesce("b_root", "b").alias("root"), F.coalesce("a_root", "a").alias("main")))
    # The largest size a partner may have; groups without one that small need no join.
    most = F.floor((100 + percent) * (F.col("n") - F.col("place")) / percent) - F.col("n")
    rest = rows.where("root <> main").withColumn("most", most)
    smallest = members.groupBy("token").agg(F.min("n").alias("smallest"))
    rest = rest.join(smallest, "token").where("most >= smallest").drop("smallest", "most")
    other = rows.select("token", *[F.col(c).alias(f"o_{c}") for c in ("doc", "n", "place", "root", "main")])
    left = F.least(F.col("n") - F.col("place"), F.col("o_n") - F.col("o_place"))
    found = rest.join(other, "token").where(
        (F.col("root") != F.col("o_root"))
        & ((F.col("o_root") == F.col("o_main")) | (F.col("doc") < F.col("o_doc")))
        & (percent * F.greatest("n", "o_n") <= 100 * F.least("n", "o_n"))
        & (left * (100 + percent) >= percent * (F.col("n") + F.col("o_n"))))
    return found.select(F.least("doc", "o_doc").alias("a"), F.greatest("doc", "o_doc").alias("b")).distinct()


def join_similar(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reached by links) of every document."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))
    with text_batches(docs.sparkSession):
        prefixes = stored(_prefixes(docs, frequent, width, percent)
                          .withColumn("row", F.monotonically_increasing_id()), "similar-prefixes")
    first = F.min(F.struct("doc_id", "row"))
    classes = (prefixes.where("digest is not null").groupBy("digest")
               .agg(first["doc_id"].alias("rep"), first["row"].alias("first_row"),
                    F.min(F.when(F.col("named"), F.col("doc_id"))).alias("least"),
                    F.count(F.lit(1)).alias("copies")))
    classes = stored(classes, "similar-classes")
    # Only one row of the smallest id of each class goes on; classes of one document need no look-up.
    several = classes.where("copies > 1").select("digest", "first_row")
    repeats = prefixes.select("digest", "row").join(several, "digest").where("row <> first_row").select("row")
    alone = keep_unmatched(prefixes.where("digest is not null"), repeats, "row", "row")
    rows = (alone.select("doc_id", "n", F.posexplode("first").alias("place", "token"))
            .select("token", F.col("doc_id").alias("doc"), "n", F.col("place").cast("long").alias("place")))
    raw = (rows.repartition("token").sortWithinPartitions("token", "place", "doc")
           .mapInArrow(_paired(percent), "token long, a long, b long, n long, place long"))
    raw = stored(raw, "similar-pairs")
    # The prefixes are the bulk of it; what comes after needs the other columns only.
    slim = stored(prefixes.select("doc_id", "named", "n", "digest"), "similar-slim")
    release(prefixes)
    pairs = raw.where("token is null").select("a", "b").distinct()
    members = raw.where("token is not null")
    pairs = stored(pairs, "similar-distinct")
    ids = stored(_ends(pairs).unionByName(members.select(F.col("b").alias("doc"))).distinct(), "similar-ids")
    with text_batches(docs.sparkSession):
        orders = stored(_other_orders(docs, ids, frequent, width, percent), "similar-orders")
    links = _links(docs, pairs, orders, width, percent)
    release(pairs, ids)
    more = None
    if not members.isEmpty():
        parts = components(links)
        remaining = stored(_remaining(members, parts, percent), "similar-remaining")
        more = _links(docs, remaining, orders, width, percent)
        release(remaining)
    release(raw, orders)
    roots = components(links if more is None else links.unionByName(more))
    release(links, *([] if more is None else [more]))
    frequent.destroy()  # all that reads it is stored
    rooted = classes.select(F.col("digest").alias("_digest"), "rep", "least").join(
        roots, F.col("rep") == roots["node"], "left")
    # A root may stand for rows without an id: the smallest id of its classes names the component.
    names = rooted.where("root is not null").groupBy(F.col("root").alias("_root")).agg(
        F.min("least").alias("name"))
    classes = rooted.join(names, F.col("root") == F.col("_root"), "left").select(
        "_digest", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("name")).alias("component"))
    own = F.when(F.col("named"), F.col("doc_id"))
    return (slim.select(own.alias("doc_id"), "n", "digest")
            .join(classes, F.col("digest") == F.col("_digest"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component", "doc_id").alias("component_id")))


def _all_candidates(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Every pair of the documents of each shingle that may link, once.

    A group is split into blocks by hash, and every two blocks meet under a key of their own.
    """
    sizes = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where(
        "blocks > 1")
    dealt = rows.join(sizes, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = stored(dealt.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")),
                   "similar-blocks")
    low = dealt.select("token", F.col("own").alias("low"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("high"),
                       F.col("doc").alias("l_doc"), F.col("n").alias("l_n"), F.col("place").alias("l_place"))
    high = dealt.select("token", F.explode(F.expr("sequence(0, own)")).alias("low"), F.col("own").alias("high"),
                        F.col("doc").alias("h_doc"), F.col("n").alias("h_n"), F.col("place").alias("h_place"))
    left = F.least(F.col("l_n") - F.col("l_place"), F.col("h_n") - F.col("h_place"))
    good = (((F.col("low") != F.col("high")) | (F.col("l_doc") < F.col("h_doc")))
            & (percent * F.greatest("l_n", "h_n") <= 100 * F.least("l_n", "h_n"))
            & (left * (100 + percent) >= percent * (F.col("l_n") + F.col("h_n"))))
    pairs = stored(low.join(high, ["token", "low", "high"]).where(good).select(
        F.least("l_doc", "h_doc").alias("a"), F.greatest("l_doc", "h_doc").alias("b")).distinct(), "similar-pairs")
    release(dealt)
    return pairs


def exact_links(docs: DataFrame, *, width: int = 5, percent: int = 80,
                block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links between classes of equal sets, a < b, and the members of the classes.

    Members are one row for each row of ``docs``: doc_id, n_shingles, ``class`` (null without shingles)
    and ``copies``, the rows of the class. Here every row is a document of its own, also one without
    an id or with the id of another. The links of documents are those of their classes, and all pairs
    within a class.
    """
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"),
                               F.col("doc_id").cast("long").alias("own_id"), "text"), "similar-keyed")
    named = keyed.select(F.col("key").alias("doc_id"), "text")
    frequent = named.sparkSession.sparkContext.broadcast(frequent_shingles(named, width))
    with text_batches(named.sparkSession):
        prefixes = stored(_prefixes(named, frequent, width, percent), "similar-prefixes")
    classes = stored(prefixes.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("copies")), "similar-classes")
    first = prefixes.join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi")
    rows = (first.select(F.col("doc_id").alias("doc"), "n", F.posexplode("first").alias("place", "token"))
            .select("token", "doc", "n", F.col("place").cast("long").alias("place")))
    pairs = _all_candidates(rows, percent, block)
    ids = stored(_ends(pairs).distinct(), "similar-ids")
    with text_batches(named.sparkSession):
        orders = stored(_other_orders(named, ids, frequent, width, percent), "similar-orders")
    frequent.destroy()
    links = _links(named, pairs, orders, width, percent)
    release(pairs, ids, orders)
    members = (prefixes.select("doc_id", F.col("n").alias("n_shingles"), "digest")
               .join(classes, "digest", "left")
               .join(keyed.select(F.col("key").alias("doc_id"), "own_id"), "doc_id")
               .select(F.col("own_id").alias("doc_id"), "n_shingles", "class", "copies"))
    members = stored(members, "similar-members")
    release(keyed, prefixes, classes)
    return links, members


def count_links(docs: DataFrame, *, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and n_links, the other documents it links with, of every row of ``docs``."""
    links, members = exact_links(docs, width=width, percent=percent, block=block)
    copies = members.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("others"))
    ends = links.select(F.col("a").alias("own"), F.col("b").alias("class")).unionByName(
        links.select(F.col("b").alias("own"), F.col("a").alias("class")))
    sums = ends.join(copies, "class").groupBy("own").agg(F.sum("others").alias("others"))
    return members.join(sums, F.col("class") == F.col("own"), "left").select(
        "doc_id", "n_shingles",
        F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links"))
