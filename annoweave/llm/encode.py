"""SentencePiece encoding and decoding, with forward scores shared along prefixes of words.

The distinct marked words of a run of documents are sorted, which lays them out as a trie in depth-first
order: a word starts from the forward states of the prefix it shares with the one before and works out
the rest only. For a unigram model the state of a prefix is its best score and last piece (Viterbi; of
equal scores the longest last piece wins). For a BPE model it is the last token, the one that merging
would leave there. Documents are then put together from their words.

Results are those of the public library for the same model file. Words in which pieces of equal score
compete (runs of spaces) are merged plainly. Scores are summed in double precision, word by word; the
library sums whole texts in single precision, which can round scores of very different size to a tie.

Defined cases: a null text gives null ids and decodes to null; an empty one gives no ids and decodes to
the empty text. Decoding gives back any text without U+2581, which stands for a space, and without
characters that have no UTF-8 form. Ids outside the vocabulary, and null ids, decode to nothing.
Repeated rows are encoded one by one. Kept columns come first; one named like a result gives way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from annoweave.llm.pieces import (BPE, BYTE, CONTROL, MARK, UNKNOWN, UNKNOWN_TEXT, Cutter, Merged, Model,
                                  merges)
from annoweave.llm.words import runs

#: Distinct words of a run: long runs share more.
RUN = 200_000


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


class _Coded(dict):
    """The ids of a token as bytes of 32-bit numbers, looked up once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> bytes:
        found = self[token] = np.array(self.model.spelled(token), dtype=np.int32).tobytes()
        return found


def best_codes(model: Model, words: Iterable[str], coded: dict[str, bytes]) -> Iterator[bytes]:
    """Viterbi over sorted distinct words: the ids of each word's best segmentation, as bytes."""
    ids, scores, longest, unknown = model.ids, model.scores, model.longest, model.unknown_score
    score, codes = [0.0], [b""]  # forward states: best score of a prefix and its pieces
    before = ""
    for word in words:
        keep = _shared(before, word)
        del score[keep + 1:], codes[keep + 1:]
        for end in range(keep + 1, len(word) + 1):
            best, at = None, 0
            for start in range(end - longest if end > longest else 0, end):
                i = ids.get(word[start:end])
                if i is not None:
                    total = score[start] + scores[i]
                elif start == end - 1:
                    total = score[start] + unknown
                else:
                    continue
                if best is None or total > best:
                    best, at = total, start
            score.append(best)
            codes.append(codes[at] + coded[word[at:end]])
        before = word
        yield codes[-1]


def beginnings(model: Model) -> frozenset[str]:
    """Every prefix of every piece: the vocabulary's own trie."""
    return frozenset(piece[:i] for piece in model.ids for i in range(1, len(piece) + 1))


def merged_codes(model: Model, rule: Merged, words: Iterable[str], coded: dict[str, bytes]) -> Iterator[bytes]:
    """Byte-pair merging over sorted distinct words, by the last token of every prefix."""
    ids, known, follows, trie = model.ids, rule.known, rule.follows, model.kept(beginnings)
    # Forward states: last token of a prefix, all its tokens, and where pieces that may go on began.
    last, codes, begun = [""], [b""], [[]]
    before = ""
    for word in words:
        if not rule.shared(word):
            yield b"".join(coded[token] for token in merges(model, list(word)))
            continue
        keep = _shared(before, word)
        del last[keep + 1:], codes[keep + 1:], begun[keep + 1:]
        for end in range(keep + 1, len(word) + 1):
            starts = [start for start in begun[end - 1] if word[start:end] in trie]
            starts.append(end - 1)
            begun.append(starts)
            for start in starts:
                token = word[start:end]
                if token in ids or start == end - 1:
                    fits = known.get((last[start], token))
                    if fits or fits is None and follows(last[start], token):
                        last.append(token)
                        codes.append(codes[start] + coded[token])
                        break
        before = word
        yield codes[-1]


def _texts(model: Model) -> list[bytes]:
    """The bytes each piece stands for, and none for what is no piece."""
    out = []
    for piece, kind in zip(model.pieces, model.types):
        if kind == BYTE:
            out.append(bytes([int(piece[3:5], 16)]))
        elif kind == CONTROL:
            out.append(b"")
        else:
            out.append((UNKNOWN_TEXT if kind == UNKNOWN else piece.replace(MARK, " ")).encode())
    return [*out, b""]


def decoded(model: Model, ids: list[int]) -> str:
    """The text of pieces; ids of no piece must come as the size of the vocabulary."""
    text = b"".join(map(model.kept(_texts).__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), *, check: bool = False) -> DataFrame:
    """The columns ``keep`` and ``ids``, the pieces of each whole text.

    With ``check`` there is ``round_trip`` as well: whether decoding the ids gives back the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    results = results[:1 + check]
    keep = [c for c in keep if c not in [f.name for f in results]]
    schema = T.StructType([docs.schema[c] for c in keep] + results)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cut, rule, tokens = m.kept(Cutter), m.kept(Merged), m.kept(_Coded)
        for batch in batches:
            done = 0
            for words, numbers, stops in runs((t.as_py() for t in batch.column(0)), cut, RUN):
                order = sorted(range(len(words)), key=words.__getitem__)
                ordered = [words[i] for i in order]
                found = (merged_codes(m, rule, ordered, tokens) if m.kind == BPE
                         else best_codes(m, ordered, tokens))
                coded: list = [None] * len(words)
                for i, code in zip(order, found):
                    coded[i] = code
                rows = batch.slice(done, len(stops))  # a run's rows go out at once
                done += len(stops)
                parts, same, at = [], [], 0
                for text, stop in zip(rows.column(0), stops.tolist()):
                    part = np.frombuffer(b"".join(map(coded.__getitem__, numbers[at:stop].tolist())), dtype=np.int32)
                    at = stop
                    parts.append(part)
                    if check:
                        plain = text.as_py()
                        same.append(plain is None or decoded(m, part.tolist()) == plain)
                ends = np.cumsum([0] + [len(p) for p in parts])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)),
                                               mask=rows.column(0).is_null())
                more = [pa.array(same, pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], ids, *more], schema.names)

    text = docs["text"].alias("_whole_text")
    return docs.select(text, *[docs[c] for c in keep]).mapInArrow(work, schema)


def decode(rows: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``text``, put together from ``ids``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c != "text"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(0)
            ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids[(ids < 0) | (ids >= len(m.pieces))] = len(m.pieces)  # stands for nothing
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            out: list = []
            at = 0
            for end, there in zip(ends.tolist(), column.is_valid().to_pylist()):
                out.append(decoded(m, ids[at:end].tolist()) if there else None)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], [*keep, "text"])

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    return rows.select(rows["ids"].alias("_ids"), *[rows[c] for c in keep]).mapInArrow(work, schema)
