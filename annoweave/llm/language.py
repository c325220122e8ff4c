"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree holds how often each byte followed each context
of up to ``ORDER`` bytes. A byte unseen in a context costs that context's escape (method C) and is
coded in the next shorter one, at last uniformly over 256 bytes. The statistics are frozen after
training, and the language with the shortest exact code length of the whole text wins.

Texts are lower-cased and cut at white space; contexts start at the space before a word, so the code
length of a word is the same wherever it stands and is worked out once per distinct word and run.

Defined cases: a null text, or one without letters, is ``und`` with score 0, and so is every text
when there is nothing to learn from; ties go to the smaller language code; a null doc_id is in no
fold: it is neither held out nor learned from. Repeated rows are predicted one by one. Extra columns
are not read.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from annoweave.llm.words import runs, sums

ORDER = 4
#: The trees are learned from this many documents of each language, those of least hash ...
SAMPLE_DOCUMENTS = 300
#: ... and from at most so many of their distinct words, the most frequent ones.
SAMPLE_WORDS = 25_000
UNKNOWN = "und"
HELD_OUT = 2
#: Grams whose costs a task remembers, and words worked out between two looks at that number.
_CACHED_GRAMS = 200_000
_WORDS = 5_000
_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("bits_per_byte", T.DoubleType())])


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def _grams(word: bytes) -> list[bytes]:
    """Every byte of the word and the space after it, each behind its context."""
    coded = b" " + word + b" "
    return [coded[max(0, i - ORDER):i + 1] for i in range(1, len(coded))]


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, bytes], int] = {}
        for lang, word, n in zip(*(column.to_pylist() for column in batch.columns)):
            for gram in _grams(word.encode("utf-8", "replace")):
                for start in range(len(gram)):
                    key = (lang, gram[start:])
                    found[key] = found.get(key, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()),
             pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])


class Trees:
    """Frozen counts of all languages: a byte string is a context and the byte after it."""

    def __init__(self, rows: Iterable[tuple[str, bytes, int]]):
        counts: dict[str, dict[bytes, int]] = {}
        for lang, gram, n in rows:
            counts.setdefault(lang, {})[bytes(gram)] = n
        self.languages = sorted(counts)
        self.counts = [counts[lang] for lang in self.languages]
        self.contexts: list[dict[bytes, tuple[int, int]]] = []
        for grams in self.counts:
            totals: dict[bytes, tuple[int, int]] = {}
            for gram, n in grams.items():
                seen, kinds = totals.get(gram[:-1], (0, 0))
                totals[gram[:-1]] = (seen + n, kinds + 1)
            self.contexts.append(totals)

    def cost(self, gram: bytes) -> list[float]:
        """Bits for the last byte of ``gram`` after the bytes before it, by language."""
        found = []
        for counts, contexts in zip(self.counts, self.contexts):
            bits = 0.0
            for start in range(len(gram)):
                context = contexts.get(gram[start:-1])
                if context is None:
                    continue
                seen, kinds = context
                n = counts.get(gram[start:])
                if n is not None:
                    bits += math.log2((seen + kinds) / n)
                    break
                bits += math.log2((seen + kinds) / kinds)
            else:
                bits += 8.0
            found.append(bits)
        return found


def learn(docs: DataFrame, *, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> Trees:
    """Trees from a bounded sample of ``docs``, which has doc_id, text and lang (none null)."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (docs.select("lang", "doc_id").withColumn("place", F.row_number().over(first))
              .where(F.col("place") <= documents).select(F.col("doc_id").alias("chosen"), "lang"))
    # At most `documents` ids for each language: small enough to broadcast.
    text = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
            .select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''"))
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counted = (text.groupBy("lang", "word").count().withColumnRenamed("count", "n")
               .withColumn("place", F.row_number().over(common)).where(F.col("place") <= words)
               .select("lang", "word", "n"))
    grams = (counted.mapInArrow(_count_grams, "lang string, gram binary, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return Trees(tuple(r) for r in grams.toLocalIterator())


def _word_costs(trees: Trees, words: list[str], known: dict[bytes, int], costs: array) -> np.ndarray:
    """Code length of each word in each language. ``known`` and ``costs`` remember grams."""
    kinds = len(trees.languages)
    done = np.zeros((len(words), kinds))
    for at in range(0, len(words), _WORDS):
        if len(known) > _CACHED_GRAMS:
            known.clear()
            del costs[:]
        found, ends = [], []
        for word in words[at:at + _WORDS]:
            for gram in _grams(word.encode("utf-8", "surrogatepass")):
                row = known.get(gram)
                if row is None:
                    row = known[gram] = len(known)
                    costs.extend(trees.cost(gram))
                found.append(row)
            ends.append(len(found))
        table = np.array(costs).reshape(-1, kinds)
        done[at:at + _WORDS] = sums(table[found], np.array(ends))
    return done


def predict(docs: DataFrame, trees: Trees, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and lang_pred, score and bits_per_byte of every whole text.

    The score is the winner's posterior with all languages equally likely beforehand. A kept column
    of one of these names gives way to the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    keep = [c for c in keep if c not in _RESULT.names]
    schema = T.StructType([docs.schema[c] for c in keep] + _RESULT.fields)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[bytes, int] = {}
        costs = array("d")  # a row of all languages for each gram
        for batch in batches:
            sizes: list[int] = []  # bytes of each text that can be told, else 0

            def lowered(column=batch.column(0), sizes=sizes):
                for value in column:
                    text = value.as_py() if model.languages else None
                    told = text is not None and any(map(str.isalpha, text))
                    sizes.append(len(text.encode()) if told else 0)
                    yield text.lower() if told else None

            bits = []
            for words, ids, ends in runs(lowered(), str.split):
                bits.append(sums(_word_costs(model, words, known, costs)[ids], ends))
            names, sure, rate = [], [], []
            for size, lengths in zip(sizes, (row for part in bits for row in part)):
                if size:
                    best = int(lengths.argmin())
                    names.append(model.languages[best])
                    sure.append(float(1.0 / np.exp2(np.maximum(lengths[best] - lengths, -1000)).sum()))
                    rate.append(float(lengths[best]) / size)
                else:
                    names.append(UNKNOWN)
                    sure.append(0.0)
                    rate.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(sure, pa.float64()),
                 pa.array(rate, pa.float64())], schema.names)

    text = F.col("text").alias("_whole_text")
    return docs.select(text, *keep).mapInArrow(score, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document.

    Learns from the text and lang of the documents outside the held-out fold; predicts from the
    text alone.
    """
    part = fold()
    known = docs.select("doc_id", "text", "lang").where(
        (part != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = predict(docs, learn(known))
    return found.select("doc_id", F.coalesce(part == HELD_OUT, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "bits_per_byte")
