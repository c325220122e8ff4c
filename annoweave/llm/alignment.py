"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often.

Every text is encoded by both tokenizers. Byte offsets at which tokens of both end cut the text into groups;
every pair of an A and a B token in a group is a link. A pair's count is the number of documents that hold it
linked. Counting is external: tasks sort the distinct (pair, document) records of many documents, split
them by radix of the A id and spill each part as a zstd-compressed run. Runs of a radix are merged by a
k-way heap, which counts each pair. Pairs are ordered by A id first, so the highest count of an A id is
known when its pairs have passed; the counts are then streamed along the runs once more, which gives back
what each document's links contribute. Runs are stored and go through the shuffle compressed; a radix with many records
is dealt to several tasks by salt, so that a token in every document is no hot spot. A task holds a bounded
number of runs, or of records not yet spilled, and the counts of one radix, which the two vocabularies bound.

Special tokens are not used: their strings in a text are plain text. Defined cases: texts that are null,
empty, or that a tokenizer does not give back byte for byte have no tokens, zeros everywhere and an empty
``groups_sha256``; repeated rows are documents of their own; an empty table gives no rows. Texts are never
cut. Kept columns come first; those named like a result give way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from annoweave.llm.common import stored

#: Radix partitions of the pairs, by the low bits of their A id.
RADIX_BITS = 4
#: Records a task sorts before it spills, and those of a radix that one task reads back.
RUN_RECORDS = 2_000_000
TASK_RECORDS = 10_000_000
#: Runs that are merged at once.
FAN_IN = 64
#: Bytes of texts encoded at once; a longer text goes alone.
TEXT_BYTES = 1 << 20
_SLICE = 1 << 20  # pairs of a large group spelled out at once
_LARGE = 4096  # links of a group from which on its equal tokens are put together first
_DOC_BITS = 28
_RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_RUN = (("radix", T.IntegerType()), ("run", T.LongType()), ("records", T.LongType()),
        ("pairs", T.BinaryType()), ("docs", T.BinaryType()), ("keys", T.BinaryType()))


# Fixed value: how a byte-level vocabulary of this kind cuts a text before its merges.
_BYTE_LEVEL_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The ranked form works on a stack that very long white space would overflow.
_LONG_SPACE = re.compile(r"\s{10000}")


def _ranked(description: dict, spelled: list[bytes]):
    """The same byte-level vocabulary for the faster library, or None if ranks do not describe it.

    Ranks do if a text is not changed before it is cut in the common way, and merges come in the order of
    the ids they make.
    """
    cut, model = description.get("pre_tokenizer") or {}, description["model"]
    plain = (cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
             and not description.get("normalizer") and model["type"] == "BPE" and not model.get("ignore_merges"))
    made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    singles = sum(len(token) == 1 for token in model["vocab"])
    if not plain or None in made or sorted(set(made)) != made or len(made) + singles != len(model["vocab"]) - len(
            [t for t in description["added_tokens"] if t["content"] in model["vocab"]]):
        return None
    import tiktoken

    special = {t["id"] for t in description["added_tokens"]}
    ranks = {token: i for i, token in enumerate(spelled) if i not in special}
    return tiktoken.Encoding("byte-level", pat_str=_BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={})


class Encoders:
    """Both tokenizers, sent as the bytes of their files and set up once in each worker.

    Where ranks describe the byte-level vocabulary (see ``_ranked``) the library for ranks encodes, which gives
    the same ids several times faster.
    """

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.byte_level, self.pieces = byte_level, pieces
        self._ready = None

    def __getstate__(self):
        return {"byte_level": self.byte_level, "pieces": self.pieces, "_ready": None}

    def ready(self):
        if self._ready is None:
            import sentencepiece
            from tokenizers import Tokenizer

            a = Tokenizer.from_str(self.byte_level.decode())
            a.encode_special_tokens = True
            b = sentencepiece.SentencePieceProcessor(model_proto=self.pieces)
            plain = _plain_bytes()
            spelled_a = [b""] * a.get_vocab_size()
            for token, i in a.get_vocab().items():
                spelled_a[i] = bytes(plain[c] for c in token) if all(c in plain for c in token) else token.encode()
            spelled_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                         else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
            ranked = _ranked(json.loads(self.byte_level), spelled_a)

            def encode_a(texts: list[str]) -> list[list[int]]:
                if ranked is None or any(map(_LONG_SPACE.search, texts)):
                    return [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]
                return list(map(ranked.encode_ordinary, texts))

            self._ready = (encode_a, b, spelled_a, spelled_b, np.array(list(map(len, spelled_a))),
                           np.array(list(map(len, spelled_b))), _Digits(len(spelled_a), len(spelled_b)))
        return self._ready


def read_encoders(byte_level: str, pieces: str) -> Encoders:
    """Read the two vocabulary files on the driver; they are parameters of bounded size and are broadcast."""
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        return Encoders(a.read(), b.read())


def _plain_bytes() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible ones for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class _Digits(list):
    """Ids in decimal with what follows them: A ids before ``,`` or ``|``, then B ids before ``,`` or ``;``."""

    def __init__(self, size_a: int, size_b: int):
        super().__init__(b"%d%b" % (i, end) for size, ends in ((size_a, (b",", b"|")), (size_b, (b",", b";")))
                         for end in ends for i in range(size))
        self.size_a, self.size_b = size_a, size_b


def pair_bits(encoders: Encoders) -> int:
    """B ids per A id in a pair's number."""
    return len(encoders.ready()[3])


class Aligned:
    """The tokens, groups and links of some texts, one after the other."""

    def __init__(self, encoders: Encoders, texts: Sequence[str | None]):
        encode_a, b, spelled_a, spelled_b, long_a, long_b, digits = encoders.ready()
        self.count = len(texts)
        own = [i for i, t in enumerate(texts) if t]
        full = [" " + texts[i] for i in own]
        ids_a = encode_a(full)
        ids_b = b.encode([texts[i] for i in own], num_threads=1)
        good = []
        for n, (text, x, y) in enumerate(zip(full, ids_a, ids_b)):
            whole = text.encode()
            if b"".join(map(spelled_a.__getitem__, x)) == whole == b"".join(map(spelled_b.__getitem__, y)):
                good.append(n)
        self.docs = np.array([own[n] for n in good], dtype=np.int64)
        size_a = np.array([len(ids_a[n]) for n in good], dtype=np.int64)
        size_b = np.array([len(ids_b[n]) for n in good], dtype=np.int64)
        self.a = np.fromiter((i for n in good for i in ids_a[n]), dtype=np.int64, count=int(size_a.sum()))
        self.b = np.fromiter((i for n in good for i in ids_b[n]), dtype=np.int64, count=int(size_b.sum()))
        ends_a, ends_b = np.cumsum(long_a[self.a]), np.cumsum(long_b[self.b])
        borders = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(borders, ends_a), np.searchsorted(borders, ends_b)
        self.in_a = np.bincount(self.group_a, minlength=len(borders))
        self.in_b = np.bincount(self.group_b, minlength=len(borders))
        #: Of each document with tokens: where its tokens and groups end.
        self.stop_a, self.stop_b = np.cumsum(size_a), np.cumsum(size_b)
        last = np.searchsorted(borders, ends_a[self.stop_a - 1]) + 1 if len(good) else np.zeros(0, dtype=np.int64)
        self.size_a, self.size_b, self.stop_group = size_a, size_b, last
        self.groups = np.diff(last, prepend=0)
        links = np.concatenate(([0], np.cumsum(self.in_a * self.in_b)))
        self.links = np.diff(links[last], prepend=0) if len(good) else last
        self.digits = digits

    def digests(self) -> list[str]:
        """``groups_sha256`` of each document with tokens."""
        d = self.digits
        ends_a = np.diff(self.group_a, append=-1) != 0
        ends_b = np.diff(self.group_b, append=-1) != 0
        codes = np.concatenate((self.a + d.size_a * ends_a, 2 * d.size_a + self.b + d.size_b * ends_b))
        order = np.argsort(np.concatenate((2 * self.group_a, 2 * self.group_b + 1)), kind="stable")
        parts = list(map(d.__getitem__, codes[order].tolist()))
        stops = [0, *(self.stop_a + self.stop_b).tolist()]
        return [hashlib.sha256(b"".join(parts[x:y])[:-1]).hexdigest() for x, y in pairwise(stops)]

    def records(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (A id times ``width``, plus B id), the documents that hold them, and how many links."""
        doc_of = np.repeat(np.arange(len(self.docs)), self.groups)
        links = self.in_a * self.in_b
        start_a, start_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        small = links[self.group_a] < _LARGE
        at, group = np.flatnonzero(small), self.group_a[small]
        times = self.in_b[group]
        first = np.cumsum(times) - times
        other = np.repeat(start_b[group] - first, times) + np.arange(int(times.sum()))
        pairs = np.repeat(self.a[at], times) * width + self.b[other]
        yield pairs, np.repeat(doc_of[group], times), np.ones(len(pairs), dtype=np.int64)
        for g in np.flatnonzero(links >= _LARGE).tolist():
            x, n = np.unique(self.a[start_a[g]:start_a[g] + self.in_a[g]], return_counts=True)
            y, m = np.unique(self.b[start_b[g]:start_b[g] + self.in_b[g]], return_counts=True)
            step = max(1, _SLICE // len(y))
            for i in range(0, len(x), step):
                pairs = (x[i:i + step, None] * width + y).ravel()
                yield pairs, np.full(len(pairs), doc_of[g]), np.outer(n[i:i + step], m).ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts[order], start) if len(keys) else counts


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers as one zstd frame; like bytes of the numbers stand together."""
    parts = [struct.pack("<I", len(columns))]
    for column in columns:
        wide = column.astype("<u8")
        size = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
        parts += [struct.pack("<QB", len(wide), size), wide.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expanded(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (count,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(count):
        length, size = struct.unpack_from("<QB", data, at)
        at += 9
        wide = np.zeros((length, 8), dtype=np.uint8)
        wide[:, :size] = np.frombuffer(data, np.uint8, length * size, at).reshape(size, length).T
        out.append(wide.view("<u8").ravel().astype(np.int64))
        at += length * size
    return out


def spilled(keys: np.ndarray, counts: np.ndarray, docs: np.ndarray, width: int) -> Iterator[tuple]:
    """The runs of sorted records, one for each radix: what ``_RUN`` names.

    A key is a pair above ``_DOC_BITS`` bits that say which of ``docs`` holds it.
    """
    names = squeezed(np.diff(docs, prepend=0))
    pairs = keys >> _DOC_BITS
    radix = pairs // width & (1 << RADIX_BITS) - 1
    order = np.argsort(radix, kind="stable")
    stops = np.searchsorted(radix[order], np.arange(1, 1 + (1 << RADIX_BITS)))
    for r, (x, y) in enumerate(pairwise([0, *stops.tolist()])):
        if x < y:
            mine = order[x:y]
            start = np.flatnonzero(np.diff(pairs[mine], prepend=-1))
            found = pairs[mine][start]
            yield (r, int(docs[0]), y - x,
                   squeezed(np.diff(found, prepend=0), np.diff(start, append=y - x)),
                   squeezed(keys[mine] & (1 << _DOC_BITS) - 1, counts[mine]), names)


def merged(runs: Sequence[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """K-way heap merge of runs (pairs in order, documents of each): each pair once, with its sum."""
    streams = [zip(pairs.tolist(), counts.tolist()) for pairs, counts in runs]
    last, total = None, 0
    for pair, n in heapq.merge(*streams):
        if pair == last:
            total += n
        else:
            if last is not None:
                yield last, total
            last, total = pair, n
    if last is not None:
        yield last, total


def _portions(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Consecutive texts of a bounded number of bytes: where they start, and they."""
    start, part, size = 0, [], 0
    for i, text in enumerate(texts):
        plain = text.as_py()
        if part and size + len(plain or "") > TEXT_BYTES:
            yield start, part
            start, part, size = i, [], 0
        part.append(plain)
        size += len(plain or "")
    if part:
        yield start, part


def _encode(shared, names: list[str], types: list[pa.DataType]):
    """Digests of documents, and their records in runs; rows are one or the other."""
    width_runs = len(_RUN)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = shared.value
        width = pair_bits(encoders)
        parts, docs, held = [], [], 0

        def runs():
            keys, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
            order = np.argsort(keys, kind="stable")
            rows = list(spilled(keys[order], counts[order], np.concatenate(docs), width))
            nulls = [pa.nulls(len(rows), t) for t in types[:-width_runs]]
            found = [pa.array([row[i] for row in rows], t) for i, t in enumerate(types[-width_runs:])]
            return pa.RecordBatch.from_arrays(nulls + found, names)

        for batch in batches:
            for start, texts in _portions(batch.column(0)):
                aligned = Aligned(encoders, texts)
                rows = batch.slice(start, len(texts))
                numbers = np.zeros((4, len(texts)), dtype=np.int64)
                numbers[:, aligned.docs] = aligned.size_a, aligned.size_b, aligned.groups, aligned.links
                shas = [""] * len(texts)
                for i, sha in zip(aligned.docs.tolist(), aligned.digests()):
                    shas[i] = sha
                more = [pa.array(column) for column in numbers] + [pa.array(shas, pa.string())]
                nulls = [pa.nulls(len(texts), t) for t in types[-width_runs:]]
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], *more, *nulls], names)
                if not len(aligned.docs):
                    continue
                base = sum(map(len, docs))
                docs.append(rows.column(1).to_numpy()[aligned.docs])
                found = [_summed((pairs << _DOC_BITS) + base + doc, n) for pairs, doc, n in aligned.records(width)]
                part = _summed(*(np.concatenate([f[i] for f in found]) for i in range(2)))
                parts.append(part)
                held += len(part[0])
                if held >= RUN_RECORDS or base + len(texts) >= 1 << _DOC_BITS - 1:
                    yield runs()
                    parts, docs, held = [], [], 0
        if held:
            yield runs()
    return work


def _count_pairs(width: int):
    """Heap merges of at most ``FAN_IN`` runs of one radix: radix, a, b, n."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radix, runs = None, []

        def counted():
            found = np.array(list(merged(runs)), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), radix, dtype=np.int32)), pa.array(found[:, 0] // width),
                 pa.array(found[:, 0] % width), pa.array(found[:, 1])], ["radix", "a", "b", "n"])

        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if runs and (r != radix or len(runs) >= FAN_IN):
                    yield counted()
                    runs = []
                radix = r
                pairs, docs = expanded(blob.as_py())
                runs.append((np.cumsum(pairs), docs))
        if runs:
            yield counted()
    return work


def _give_back(width: int):
    """What the links in each run contribute to its documents: key, n_best, count_sum.

    Rows come by radix and salt: first the counts of its pairs by A id, then its runs.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known, table = None, [], None
        for batch in batches:
            for row in range(len(batch)):
                radix, salt, a, best, bs, ns, pairs, docs, keys = (c[row] for c in batch.columns)
                if (radix.as_py(), salt.as_py()) != group:
                    group, known, table = (radix.as_py(), salt.as_py()), [], None
                if a.is_valid:
                    n = ns.values.to_numpy()
                    known.append((a.as_py() * width + bs.values.to_numpy(), n, n == best.as_py()))
                    continue
                if table is None:
                    table = [np.concatenate([k[i] for k in known]) for i in range(3)]
                    known = []
                steps, times = expanded(pairs.as_py())
                local, links = expanded(docs.as_py())
                names = np.cumsum(expanded(keys.as_py())[0])
                at = np.searchsorted(table[0], np.cumsum(steps))
                sums, bests = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
                np.add.at(sums, local, np.repeat(table[1][at], times) * links)
                np.add.at(bests, local, np.repeat(table[2][at], times) * links)
                there = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[there]), pa.array(bests[there]), pa.array(sums[there])],
                    ["_key", "n_best", "count_sum"])
    return work


def align(docs: DataFrame, encoders: Encoders, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, of each whole text, its tokens, groups and links and what they count."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(encoders)
    width = pair_bits(encoders)
    keep = [c for c in keep if c not in _RESULTS]
    numbered = docs.select(docs["text"].alias("_text"), F.monotonically_increasing_id().alias("_key"),
                           *[docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in numbered.schema.fields[1:]])
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema.add(name, T.LongType())
    schema.add("groups_sha256", T.StringType())
    for name, kind in _RUN:
        schema.add(name, kind)
    types = [to_arrow_type(f.dataType) for f in schema]
    found = stored(numbered.mapInArrow(_encode(shared, schema.names, types), schema), "alignment")
    shared.destroy()
    runs = found.where(F.col("radix").isNotNull())
    # As many salts for each radix as its records need; at most 2 ** RADIX_BITS rows.
    sizes = {r["radix"]: -(-r["n"] // TASK_RECORDS)
             for r in runs.groupBy("radix").agg(F.sum("records").alias("n")).collect()}
    tasks = max(1, sum(sizes.values()))
    salts = F.lit(1)
    for radix, n in sizes.items():
        salts = F.when(F.col("radix") == radix, F.lit(n)).otherwise(salts)
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("run"), salts.cast("long")).cast("int"))
    partial = (salted.select("radix", "pairs", "salt").repartition(tasks, "radix", "salt")
               .sortWithinPartitions("radix").select("radix", "pairs")
               .mapInArrow(_count_pairs(width), "radix int, a long, b long, n long"))
    counts = partial.groupBy("radix", "a", "b").agg(F.sum("n").alias("n"))
    by_a = stored(counts.groupBy("radix", "a").agg(
        F.max("n").alias("best"), F.sort_array(F.collect_list(F.struct("b", "n"))).alias("_pairs"))
        .select("radix", "a", "best", F.col("_pairs.b").alias("bs"), F.col("_pairs.n").alias("ns")), "alignment-pairs")
    none = F.lit(None)
    counted = by_a.select("radix", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)).alias("salt"), "a", "best",
                          "bs", "ns", *[none.cast("binary").alias(c) for c in ("pairs", "docs", "keys")])
    spread = salted.select("radix", "salt", none.cast("long").alias("a"), none.cast("long").alias("best"),
                           none.cast("array<long>").alias("bs"), none.cast("array<long>").alias("ns"),
                           "pairs", "docs", "keys")
    given = (counted.unionByName(spread).repartition(tasks, "radix", "salt")
             .sortWithinPartitions("radix", "salt", F.col("a").asc_nulls_last())
             .mapInArrow(_give_back(width), "_key long, n_best long, count_sum long"))
    own = [f"_keep{i}" for i in range(len(keep))] + ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    plain = found.where("radix is null").select("_key", F.struct(*own).alias("_own"), F.lit(0).cast("long").alias("n_best"),
                                                F.lit(0).cast("long").alias("count_sum"))
    parts = given.select("_key", F.lit(None).cast(plain.schema["_own"].dataType).alias("_own"), "n_best", "count_sum")
    whole = plain.unionByName(parts).groupBy("_key").agg(
        F.first("_own", ignorenulls=True).alias("_own"), F.sum("n_best").alias("n_best"),
        F.sum("count_sum").alias("count_sum"))
    return whole.select(*[F.col(f"_own._keep{i}").alias(c) for i, c in enumerate(keep)],
                        *[F.col(f"_own.{c}") if c not in ("n_best", "count_sum") else F.col(c) for c in _RESULTS])

