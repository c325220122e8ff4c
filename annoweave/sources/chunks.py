"""Large JSON documents, read in byte ranges by many tasks.

A document has no record borders a task could start at: whether a byte lies in a quoted text, and how deep it
is nested, depends on all bytes before it. So the files are read twice. First every range counts its quotes
and, for either kind of start (within a quoted text or not), how far it goes up or down; running sums over these
small rows tell each range what it starts in. Then every range cuts out the elements that start in it, reading
on past its end to finish the last one, and names the member it saw last, which tells the next ranges theirs.

Every element of a member's array, and every other value of a member, is one row of text with its file and byte
offset; it is parsed by Spark with the schema of that member alone. A document whose brackets or quotes do
not match is left out as a whole and listed as damaged; an element that is no valid JSON of its member's form
is left out and listed alone.

Files are UTF-8, with or without a mark, and not compressed; others raise. They must be on a file system that
Arrow can open on every executor. Missing paths raise; empty files hold nothing; members that do not
occur give no rows; a member that occurs twice gives the elements of both.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annoweave.operators.joins import BROADCAST_ROWS
from annoweave.schemas import MEMBERS, element_schema
from annoweave.session import settle
from annoweave.sources.documents import CORRUPT, Raw

#: Bytes of a range. An element that is longer is still read whole, by the task it starts in.
CHUNK_BYTES = 16 << 20
_MORE = 1 << 20  # bytes sent on at once, and the most that is read at once to finish an element
_FIRST = 1 << 12  # bytes read first to finish an element: most end soon
_QUOTE, _COMMA, _COLON, _BACKSLASH = b'",:\\'
# What each byte does to the depth, and which bytes matter outside of quotes.
_STEP = np.zeros(256, dtype=np.int8)
_STEP[[91, 123]] = 1
_STEP[[93, 125]] = -1
_MARK = _STEP != 0
_MARK[[44, 58]] = True
_SPACES = b" \t\r\n"


def _open(path: str):
    if path.startswith("file:"):
        from urllib.parse import unquote
        return open(unquote("/" + path[5:].lstrip("/")), "rb")
    from pyarrow import fs
    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def _escaped(data: np.ndarray, before: int) -> np.ndarray:
    """Positions of quotes that are text: they follow an odd run of backslashes.

    ``before`` is the length of the run that ends where the data starts.
    """
    quotes = np.flatnonzero(data == _QUOTE)
    run = np.zeros(len(quotes), dtype=np.int64)
    going = np.arange(len(quotes))
    while len(going):
        at = quotes[going] - run[going] - 1
        run[going[at < 0]] += before
        going = going[at >= 0]
        going = going[data[quotes[going] - run[going] - 1] == _BACKSLASH]
        run[going] += 1
    return quotes[run % 2 == 1]


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Positions of quotes that open or close a text."""
    quotes = np.flatnonzero(data == _QUOTE)
    return np.setdiff1d(quotes, _escaped(data, before), assume_unique=True)


def _run_before(file, start: int) -> int:
    """Length of the run of backslashes that ends before ``start``."""
    run, step = 0, 64
    while start > 0:
        low = max(0, start - step)
        file.seek(low)
        piece = file.read(start - low)
        kept = len(piece.rstrip(b"\\"))
        run += len(piece) - kept
        if kept or not low:
            break
        start, step = low, step * 2
    return run


def _marks(data: np.ndarray, before: int, quoted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotes, brackets and commas outside of quoted texts, and the change of depth at the latter two."""
    quotes = _quotes(data, before)
    marks = np.flatnonzero(_MARK[data])
    marks = marks[(np.searchsorted(quotes, marks) + quoted) % 2 == 0]
    return quotes, marks, _STEP[data[marks]]


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: its quotes, and its change of depth and lowest depth for either kind of start."""
    for batch in batches:
        out: list[tuple] = []
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            with _open(path) as file:
                before = _run_before(file, start)
                file.seek(start)
                data = np.frombuffer(file.read(end - start), dtype=np.uint8)
            if start == 0 and (0 in data[:4] or data[:2].tolist() in ([31, 139], [254, 255], [255, 254])):
                raise ValueError(f"{path} is compressed or not UTF-8")
            row = [path, start, end, len(_quotes(data, before))]
            for quoted in (False, True):
                steps = np.cumsum(_marks(data, before, quoted)[2], dtype=np.int64)
                row += [int(steps[-1]), int(steps.min())] if len(steps) else [0, 0]
            # Text after the last bracket or before the first: a document holds one object.
            out.append((*row, bool(data[:512].tobytes().lstrip(b"\xef\xbb\xbf" + _SPACES)[:1] == b"{")))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)],
                                         ["path", "start", "end", "quotes", "plain", "plain_low", "within", "within_low",
                                          "opens"])


def _key_before(file, colon: int) -> str:
    """The name before a colon, read from the file."""
    low = max(0, colon - (64 << 10))
    file.seek(low)
    text = file.read(colon - low).rstrip(_SPACES)
    quotes = _quotes(np.frombuffer(text, dtype=np.uint8), _run_before(file, low))
    return json.loads(text[quotes[-2]:])


def _finish(file, at: int, quoted: bool, depth: int, array: bool) -> bytes:
    """The rest of an element that goes on at byte ``at``; a document that ends first ends it as well."""
    parts, size = [], _FIRST
    while True:
        before = _run_before(file, at)
        file.seek(at)
        piece = file.read(size)
        data = np.frombuffer(piece, dtype=np.uint8)
        quotes, marks, steps = _marks(data, before, quoted)
        after = depth + np.cumsum(steps, dtype=np.int64)
        ends = np.flatnonzero((after <= 1) & (steps < 0) | array & (after == 2) & (data[marks] == _COMMA))
        if len(ends):
            end = int(marks[ends[0]])
            return b"".join([*parts, piece[:end if array else end + 1]])
        if not piece:
            return b"".join(parts)
        parts.append(piece)
        at, size = at + len(piece), min(4 * size, _MORE)
        quoted = (len(quotes) + quoted) % 2 == 1
        depth = int(after[-1]) if len(after) else depth


def _elements(path: str, start: int, end: int, quoted: bool, depth: int) -> Iterator[tuple]:
    """What starts in a range, as (offset, member, array, text), and last what the next ranges must know.

    An element starts with the bracket or comma before it. Its member is null if it was named in an earlier
    range, and ``array`` is null if the value it is in was opened there. The last row has no text, but the last
    member named here and the kind of the last value opened, or nulls.
    """
    with _open(path) as file:
        before = _run_before(file, start)
        file.seek(start)
        whole = file.read(end - start)
        data = np.frombuffer(whole, dtype=np.uint8)
        quotes, marks, steps = _marks(data, before, quoted)
        kinds, after = data[marks], depth + np.cumsum(steps, dtype=np.int64)
        cuts = ((after == 1) & ((kinds == _COLON) | (steps < 0))
                | (after == 2) & ((kinds == _COMMA) | (steps > 0)))
        member = array = found = None
        named, opened = None, None
        for mark, kind in zip(marks[cuts].tolist(), kinds[cuts].tolist()):
            if kind == _COLON:
                q = np.searchsorted(quotes, mark)
                member = named = (json.loads(whole[quotes[q - 2]:quotes[q - 1] + 1]) if q >= 2
                                  else _key_before(file, start + mark))
                array = None
            elif kind in b"[{":
                array = opened = kind in b"["
                found = mark + array
            elif kind in b"}" or array is False:
                if kind in b"}" and array is False:
                    yield start + found, member, False, whole[found:mark + 1]
                    found = None
                elif kind in b"}":
                    found = None  # a value that an earlier range gives as a whole
            else:
                if found is not None and whole[found:mark].strip(_SPACES):
                    yield start + found, member, array, whole[found:mark]
                found = mark + 1 if kind == _COMMA else None
        if found is not None:
            rest = _finish(file, end, (len(quotes) + quoted) % 2 == 1, int(after[-1]), array is not False)
            text = whole[found:] + rest
            if text.strip(_SPACES):
                yield start + found, member, array, text
    yield None, named, opened, None


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "start", "pos", "member", "array", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for path, start, *more in zip(*(c.to_pylist() for c in batch.columns)):
            rows, size = [], 0
            for pos, member, array, text in _elements(path, start, *more):
                rows.append((path, start, pos, member, array, None if text is None else text.decode("utf-8", "replace")))
                size += len(text or b"")
                if size > _MORE:
                    yield sent(rows)
                    rows, size = [], 0
            if rows:
                yield sent(rows)


def _spread(ranges: DataFrame) -> DataFrame:
    """The ranges dealt to tasks: one each, or several small ones once every core has some."""
    spark = ranges.sparkSession
    count, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    tasks = min(count, max(spark.sparkContext.defaultParallelism, size // CHUNK_BYTES + 1))
    return ranges.repartition(max(1, tasks), "path", "start")


def structural_index(spark: SparkSession, path: str | list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The byte ranges of the files at ``path`` and what each starts in: path, start, end, quoted, depth, sound.

    ``sound`` says whether the file's quotes and brackets match and it holds one object. One small row for each
    range goes through the running sums.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start")).select(
        "path", "start", F.least(F.col("start") + chunk_bytes, "length").alias("end"))
    counted = settle(_spread(ranges).mapInArrow(
        _summaries, "path string, start long, end long, quotes long, plain long, plain_low long, within long, "
        "within_low long, opens boolean"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    quoted = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    stepped = counted.withColumn("quoted", quoted).select(
        "path", "start", "end", "quoted", "quotes", "opens", F.when(F.col("quoted"), F.col("within")).otherwise(F.col("plain")).alias("step"),
        F.when(F.col("quoted"), F.col("within_low")).otherwise(F.col("plain_low")).alias("low"))
    deep = stepped.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    sound = ((F.sum("quotes").over(whole) % 2 == 0) & (F.sum("step").over(whole) == 0)
             & (F.min(F.col("depth") + F.col("low")).over(whole) >= 0)
             & (F.max(F.when(F.col("start") == 0, F.col("opens"))).over(whole)))
    return deep.withColumn("sound", sound).select("path", "start", "end", "quoted", "depth", "sound")


def _parsed(name: str) -> Column:
    """The element as one of the member ``name``; null for others, for a JSON null, and for values of another form."""
    form = (F.col("member") == name) & (F.col("array") == F.lit(name != "info"))
    schema = element_schema(name).add(CORRUPT, "string").simpleString()
    return F.when(form & ~F.rlike("text", F.lit(r"^\s*null\s*$")), F.from_json(
        "text", schema, {"columnNameOfCorruptRecord": CORRUPT}))


def _broken() -> Column:
    """Whether an element is not of its member's form or no valid JSON."""
    form = F.col("array") == (F.col("member") != "info")
    return ~form | F.coalesce(*[F.col(f"{name}.{CORRUPT}") for name in MEMBERS]).isNotNull()


def read_large_documents(spark: SparkSession, path: str | list[str],
                         stage: Callable[[str, DataFrame], DataFrame] | None = None, *,
                         chunk_bytes: int = CHUNK_BYTES) -> Raw:
    """The members of the documents at ``path``, each document read by as many tasks as it has ranges.

    The rows are those of ``read_documents``. Elements are cut out and stored once, and parsed and stored once with
    a column per member, by ``stage`` or below the shared folder.
    """
    stage = stage or (lambda _, df: settle(df))
    index = settle(structural_index(spark, path, chunk_bytes))
    ranges = index.where("sound").select("path", "start", "end", "quoted", "depth")
    cut = stage("elements", _spread(ranges).mapInArrow(
        _cut, "path string, start long, pos long, member string, array boolean, text string"))
    # What ranges know at their start: one row for each.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = settle(cut.where("pos is null").select(
        F.col("path").alias("_path"), F.col("start").alias("_start"),
        F.last("member", True).over(before).alias("_member"), F.last("array", True).over(before).alias("_array")))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    found = cut.where("pos is not null").join(
        known, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
    # In a value that an earlier range opened, only arrays have elements of their own.
    elements = found.where("array is not null or _array").select(
        "path", "pos", F.coalesce("member", "_member").alias("member"), F.coalesce("array", "_array").alias("array"), "text")
    parsed = stage("parsed", elements.where(F.col("member").isin(*MEMBERS)).select(
        "path", "pos", "member", "array", "text", *[_parsed(name).alias(name) for name in MEMBERS]).select(
        "path", "pos", "member", F.when(_broken(), F.col("text")).alias("text"), *MEMBERS))
    members = {}
    for name in MEMBERS:
        order = F.struct("path") if name == "info" else F.struct("path", "pos")
        good = parsed.where((F.col("member") == name) & F.col("text").isNull())
        members[name] = good.select(order.alias("_order"), *[F.col(f"{name}.{f}").alias(f)
                                                             for f in element_schema(name).names])
    broken = parsed.where("text is not null").select(F.col("path").alias("source"), "text")
    unsound = index.where("not sound").groupBy(F.col("path").alias("source")).agg(F.concat(
        F.lit("quotes or brackets do not match in a document of "), F.max("end"), F.lit(" bytes")).alias("text"))
    return Raw(members, unsound.unionByName(broken))


def largest_file(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of the largest file at ``path``; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.agg(F.coalesce(F.max("length"), F.lit(0)).alias("length")).first()["length"]
