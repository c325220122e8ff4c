"""SentencePiece models: reading the file, and cutting text into words that are encoded one by one."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

MARK = "▁"
UNIGRAM, BPE = 1, 2
# Types of pieces, and the place of fields, in the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of one message: integers, or bytes of longer values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield number, data[at:at + size]
            at += size


@dataclass
class Model:
    """Pieces of a SentencePiece model and how text is prepared for them."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    dummy_prefix: bool
    byte_fallback: bool
    ids: dict[str, int] = field(default_factory=dict)  # of the pieces that text can match
    byte_ids: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    longest: int = 1
    tied: frozenset = frozenset()  # scores that several pieces share
    memo: dict = field(default_factory=dict, repr=False)  # what a worker keeps between its tasks

    def __post_init__(self):
        seen: dict[float, int] = {}
        for i, (piece, kind) in enumerate(zip(self.pieces, self.types)):
            if kind == NORMAL:
                self.ids[piece] = i
                seen[self.scores[i]] = seen.get(self.scores[i], 0) + 1
            elif kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
        self.longest = max(map(len, self.ids), default=1)
        self.tied = frozenset(score for score, n in seen.items() if n > 1)

    def kept(self, make):
        """``make(self)``, made once for each process that holds the model."""
        if make not in self.memo:
            self.memo[make] = make(self)
        return self.memo[make]

    @property
    def unknown_score(self) -> float:
        return min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY

    def spelled(self, token: str) -> list[int]:
        """Ids of a token: its own, or those of its bytes, or unknown."""
        i = self.ids.get(token)
        if i is not None:
            return [i]
        if self.byte_fallback:
            return [self.byte_ids[b] for b in token.encode("utf-8", "replace")]
        return [self.unknown]


def parse_model(data: bytes) -> Model:
    """Read the bytes of a model file. Only identity normalization is supported."""
    pieces, scores, types = [], [], []
    trainer = {3: UNIGRAM, 24: 0, 35: 0}
    normalizer: dict = {3: 1, 4: 1, 5: 1}
    for number, value in _fields(data):
        if number == 1:
            row = dict(_fields(value))
            pieces.append(row.get(1, b"").decode())
            scores.append(struct.unpack("<f", row[2])[0] if 2 in row else 0.0)
            types.append(row.get(3, NORMAL))
        elif number == 2:
            trainer.update((k, v) for k, v in _fields(value) if k in trainer)
        elif number == 3:
            normalizer.update(_fields(value))
    if normalizer.get(2) or normalizer[4] or not normalizer[5] or trainer[24]:
        raise ValueError("the model normalizes text in a way that is not supported")
    if trainer[3] not in (UNIGRAM, BPE) or USER_DEFINED in types:
        raise ValueError("only unigram and BPE models without user-defined pieces are supported")
    if any(MARK in piece.lstrip(MARK) for piece, kind in zip(pieces, types) if kind == NORMAL):
        raise ValueError("the model has pieces that span words")
    return Model(pieces, scores, types, trainer[3], bool(normalizer[3]), bool(trainer[35]))


def read_model(path: str) -> Model:
    """Read a model file on the driver; it is a parameter of bounded size and is broadcast."""
    with open(path, "rb") as file:
        return parse_model(file.read())


class Cutter:
    """Cuts a text into marked words: white-space marks, then characters up to the next mark.

    No piece spans such a border, so the words' encodings in a row are the text's encoding. Line feeds
    stand alone where no longer piece has one, which keeps lines from running into one word.
    """

    def __init__(self, model: Model):
        lone = not any("\n" in piece and len(piece) > 1 for piece in model.ids)
        self.pattern = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if lone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.prefix = MARK if model.dummy_prefix else ""

    def __call__(self, text: str) -> list[str]:
        return self.pattern.findall(self.prefix + text.replace(" ", MARK)) if text else []


def merges(model: Model, symbols: list[str]) -> list[str]:
    """Byte-pair merging as the model defines it: best score first, then leftmost."""
    symbols = list(symbols)
    ids, scores = model.ids, model.scores
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            found = ids.get(symbols[i] + symbols[i + 1])
            if found is not None and (best is None or scores[found] > best):
                best, at = scores[found], i
        if best is None:
            break
        symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


#: Pairs of tokens a worker remembers: about 250 bytes each.
_KNOWN_PAIRS = 250_000


class Merged:
    """Which tokens can follow each other in the result of byte-pair merging.

    Of all ways to end a prefix's encoding, merging gives exactly one: that whose last two tokens stay
    apart when merged from characters. So the last token is a forward state that prefixes can share.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[tuple[str, str], bool] = {}

    def follows(self, before: str, token: str) -> bool:
        """Whether ``token`` stays whole after ``before`` (empty at the start of a word)."""
        key = (before, token)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= _KNOWN_PAIRS:
                self.known.clear()
            want = [before, token] if before else [token]
            found = self.known[key] = merges(self.model, list(before + token)) == want
        return found

    def shared(self, word: str) -> bool:
        """Whether the rule holds: no pieces of equal score can compete in the word.

        Pieces of equal score are merged from the left, which depends on more than two tokens.
        """
        return not self.model.tied or MARK * 2 not in word
