"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

A text is cut into paragraphs (lines), these into phrases that end after a word whose last character
falls in a fixed class, and paragraphs are gathered into sections that end at a blank line or at a
paragraph whose digest falls in a class. All cuts depend on the content around them alone, so an edit
changes the branches it touches and no others. A phrase is hashed; every other node hashes the digests
below it. Equal roots mean equal texts; where roots differ, differing branches locate the edits.

The written form is ``root:section|section``, a section being paragraphs joined by commas and a
paragraph its phrases' digests, six hex digits each. Likeness is the Dice coefficient of two texts'
phrases as multisets: by their whole digests of 64 bits where the texts are at hand, else read off the
written forms, whose short digests meet by chance in texts of many thousand phrases.

Defined cases: a null text counts as empty; two empty texts are alike (1); the empty text and another
are not (0). Documents follow each other by doc_id, null first, then by text; repeated rows each get
their own result. A single document is its own successor. An empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One of so many phrase (section) ends is taken, about.
PHRASE_EVERY = 4
SECTION_EVERY = 8
#: A phrase without such an end is cut after so many characters.
PHRASE_MOST = 48
_SHORT = 6  # hex digits of a phrase in the written form
_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
#: Characters after which, before white space, a phrase ends: every fourth code point of the first plane.
_ENDS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0, 0xD800, PHRASE_EVERY)
                                 if not chr(c).isspace()) + r"]\s+")
_EMIT_CHARS = 1 << 22
_NULL_KEY = -2 ** 63


def _hash(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def paragraph_node(paragraph: str) -> tuple[bytes, str, bytes]:
    """Digest of a paragraph, its phrases' short digests, and the whole ones."""
    ends = [m.end() for m in _ENDS.finditer(paragraph)]
    if not ends or ends[-1] < len(paragraph):
        ends.append(len(paragraph))
    whole, short, at = [], [], 0
    for end in ends:
        while at < end:
            stop = min(end, at + PHRASE_MOST)
            leaf = hashlib.blake2b(paragraph[at:stop].encode("utf-8", "surrogatepass"), digest_size=8).digest()
            whole.append(leaf)
            short.append(leaf[:_SHORT // 2].hex())
            at = stop
    return _hash(*whole), "".join(short), b"".join(whole)


def fingerprint(text: str | None, known: dict | None = None) -> str:
    """The written Merkle tree of a text. ``known`` remembers paragraphs between calls."""
    return tree(text, {} if known is None else known)[0]


def tree(text: str | None, known: dict) -> tuple[str, np.ndarray]:
    """The written Merkle tree of a text and the whole digests of its phrases."""
    sections, nodes, written, top, leaves = [], [], [], [], []
    for paragraph in _PARAGRAPH.findall(text or ""):
        node = known.get(paragraph)
        if node is None:
            node = known[paragraph] = paragraph_node(paragraph)
        nodes.append(node[0])
        written.append(node[1])
        leaves.append(node[2])
        if not paragraph.strip() or node[0][0] % SECTION_EVERY == 0:
            top.append(_hash(b"s", *nodes))
            sections.append(",".join(written))
            nodes, written = [], []
    if nodes:
        top.append(_hash(b"s", *nodes))
        sections.append(",".join(written))
    return _hash(b"t", *top).hex()[:32] + ":" + "|".join(sections), np.frombuffer(b"".join(leaves), np.uint64)


def _phrases(written: str) -> Counter:
    flat = written.partition(":")[2].replace("|", "").replace(",", "")
    return Counter(flat[i:i + _SHORT] for i in range(0, len(flat), _SHORT))


def _dice(a: Counter, b: Counter) -> float:
    if len(b) < len(a):
        a, b = b, a
    whole = a.total() + b.total()
    return 2.0 * sum(min(n, b[x]) for x, n in a.items() if x in b) / whole if whole else 1.0


def _counted(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(leaves, return_counts=True)


def _dice_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The Dice coefficient of two multisets of whole digests."""
    whole = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return 2.0 * int(np.minimum(a[1][i], b[1][j]).sum()) / whole if whole else 1.0


def likeness(a: str, b: str) -> float:
    """How alike two fingerprinted texts are, 0 to 1; equal roots are 1."""
    return 1.0 if a[:32] == b[:32] else _dice(_phrases(a), _phrases(b))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places in ``a`` of the paragraphs that ``b`` does not have."""
    if a[:32] == b[:32]:
        return []
    theirs = Counter(b.partition(":")[2].split("|"))
    paragraphs = Counter(p for s in theirs for p in s.split(","))
    return [(i, j) for i, section in enumerate(a.partition(":")[2].split("|")) if not theirs[section]
            for j, paragraph in enumerate(section.split(",")) if not paragraphs[paragraph]]


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the following one."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _keys(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NULL_KEY).to_numpy(zero_copy_only=False)


def _firsts(ids: DataFrame, bounds: np.ndarray) -> dict[int, int]:
    """The least key in each range that has rows; one number for each range."""
    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            keys = _keys(batch.column(0))
            order = np.sort(keys)
            parts, first = np.unique(np.searchsorted(bounds, order, side="right"), return_index=True)
            for part, at in zip(parts.tolist(), first.tolist()):
                found[part] = min(int(order[at]), found.get(part, 2 ** 63 - 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["part", "key"])

    rows = ids.mapInArrow(least, "part long, key long").groupBy("part").agg(F.min("key").alias("key"))
    return {r["part"]: r["key"] for r in rows.collect()}


def _results(schema):
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        last = None  # part, doc_id, text, its paragraphs, its fingerprint, its counted phrases
        for batch in batches:
            for part, doc_id, text, extra in zip(*batch.columns):
                part, extra, text = part.as_py(), extra.as_py(), text.as_py() or ""
                if last is not None and last[0] != part:
                    last = None  # the range before ended with its extra row
                if extra and last is None:
                    continue  # a further extra row: the first one has been used
                known: dict = {}
                own, leaves = tree(text, known)
                counted = _counted(leaves)
                if last is not None:
                    _, before, old, paragraphs, old_print, phrases = last
                    new = edited(old, text)
                    new_print, new_leaves = tree(new, paragraphs | known)
                    near = [1.0 if old_print[:32] == other[:32] else _dice_of(phrases, theirs)
                            for other, theirs in ((new_print, _counted(new_leaves)), (own, counted))]
                    out.append((before, len(old),
                                hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                                old_print, new_print, *near))
                    chars += len(old)
                last = None if extra else (part, doc_id.as_py(), text, known, own, counted)
                if chars > _EMIT_CHARS:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema.names)
                    out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema.names)
    return compare


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next text's are.

    Documents are dealt to ranges of doc_id and sorted there, so each row meets its successor; a copy
    of the first document of each range goes to the range before (that of the very first to the
    last). One shuffle of the texts; a task holds two documents at a time.
    """
    spark: SparkSession = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / parts for i in range(1, parts)]
    ids = docs.select("doc_id")
    cuts = ids.where("doc_id is not null").select(F.col("doc_id").cast("long")).approxQuantile(
        "doc_id", steps, 1 / (4 * parts)) if steps else []
    bounds = np.unique(np.array(cuts, dtype=np.int64))
    firsts = _firsts(ids, bounds)
    filled = sorted(firsts)
    # The keys that begin a range, and the range before, which they are copied to.
    before = {firsts[part]: filled[i - 1] for i, part in enumerate(filled)}
    heads = np.array(sorted(before), dtype=np.int64)
    homes = np.array([before[k] for k in sorted(before)], dtype=np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column(0))
            home = np.searchsorted(bounds, keys, side="right")
            own = [pa.array(home, pa.int32()), pa.array(keys), batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.zeros(len(keys), bool))], names)
            copies = np.flatnonzero(np.isin(keys, heads))
            if len(copies):
                target = homes[np.searchsorted(heads, keys[copies])]
                rows = batch.take(pa.array(copies))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(target, pa.int32()), pa.array(keys[copies]), rows.column(0), rows.column(1),
                     pa.array(np.ones(len(copies), bool))], names)

    names = ["part", "key", "doc_id", "text", "extra"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").mapInArrow(
        deal, f"part int, key long, doc_id {kind}, text string, extra boolean")
    dealt = (dealt.repartitionById(max(1, len(bounds) + 1), "part")
             .sortWithinPartitions("part", "extra", "key", F.coalesce("text", F.lit(""))))
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()),
                        ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                        ("near_next", pa.float64())])
    return dealt.select("part", "doc_id", "text", "extra").mapInArrow(
        _results(schema), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                          "edited_fingerprint string, near_edited double, near_next double")
