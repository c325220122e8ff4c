"""Token counts without the tokens: a count-only forward pass over vocabulary matches.

An Aho-Corasick automaton of the vocabulary names, in one pass over a word, every piece that ends at each
place, the longest first. A forward pass carries, for each prefix, the best score and how many pieces it
takes (unigram models; of equal scores the longest last piece wins, as in the tokenizer), or the last
token that byte-pair merging leaves and how many come before it (BPE models). No path is kept and nothing
is spelled out. Each distinct word of a run of documents is counted once.

Counts equal the number of ids that encoding gives. Defined cases: a null or empty text has 0 tokens;
repeated rows are counted one by one; an empty table gives no rows. Kept columns come first; one named
``n_tokens`` gives way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from annoweave.llm.pieces import BPE, Cutter, Merged, Model, merges
from annoweave.llm.words import runs, sums

#: Distinct words of a run.
RUN = 200_000


def automaton(model: Model) -> ahocorasick.Automaton:
    """All pieces that text can match; a match gives the piece and its score."""
    found = ahocorasick.Automaton()
    for piece, i in model.ids.items():
        found.add_word(piece, (piece, model.scores[i]))
    found.make_automaton()
    return found


def best_counts(model: Model, matches: ahocorasick.Automaton, words: Iterable[str]) -> Iterator[int]:
    """Pieces in the best segmentation of each word, by score."""
    ids, unknown = model.ids, model.unknown_score
    for word in words:
        size = len(word)
        best: list = [0.0] + [None] * size
        count = [0] * (size + 1)
        done = 0

        def settle(to: int):
            """Close the prefixes before ``to``: a character without a piece of its own is unknown."""
            for end in range(done + 1, to):
                if word[end - 1] not in ids:
                    total = best[end - 1] + unknown
                    if best[end] is None or total > best[end]:
                        best[end] = total
                        count[end] = count[end - 1] + len(model.spelled(word[end - 1]))

        for at, (piece, score) in matches.iter(word):
            end = at + 1
            if end > done + 1:
                settle(end)
                done = end - 1
            start = end - len(piece)
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end] = total
                count[end] = count[start] + 1
        settle(size + 1)
        yield count[size]


def merged_counts(model: Model, rule: Merged, matches: ahocorasick.Automaton,
                  words: Iterable[str]) -> Iterator[int]:
    """Tokens that byte-pair merging leaves of each word."""
    known, follows = rule.known, rule.follows
    for word in words:
        if not rule.shared(word):
            yield sum(len(model.spelled(token)) for token in merges(model, list(word)))
            continue
        last, count = [""], [0]
        done = 0
        for at, (piece, _) in matches.iter(word):
            end = at + 1
            if end <= done:
                continue  # this prefix has its last token
            while done < end - 1:  # no piece ends here: the character is unknown
                last.append(word[done])
                count.append(count[done] + len(model.spelled(word[done])))
                done += 1
            start = end - len(piece)
            fits = known.get((last[start], piece))
            if fits or fits is None and follows(last[start], piece):
                last.append(piece)
                count.append(count[start] + 1)
                done = end
        while done < len(word):
            count.append(count[done] + len(model.spelled(word[done])))
            done += 1
        yield count[-1]


def count_tokens(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c != "n_tokens"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cut, rule, matches = m.kept(Cutter), m.kept(Merged), m.kept(automaton)
        for batch in batches:
            parts = [np.zeros(0, dtype=np.int64)]
            for words, ids, ends in runs((t.as_py() for t in batch.column(0)), cut, RUN):
                counted = merged_counts(m, rule, matches, words) if m.kind == BPE else best_counts(m, matches, words)
                each = np.fromiter(counted, dtype=np.int64, count=len(words))
                parts.append(sums(each[ids] if len(ids) else each[:0], ends))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.concatenate(parts))], [*keep, "n_tokens"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())])
    return docs.select(docs["text"].alias("_whole_text"), *[docs[c] for c in keep]).mapInArrow(work, schema)
