"""Work done once for each distinct word of a run of documents, inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: A run of documents ends once it holds this many distinct words, which bounds memory.
RUN_WORDS = 150_000


class _Numbered(dict):
    """Numbers its keys in the order in which they are first looked up."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def runs(texts: Iterable[str | None], cut: Callable[[str], list[str]],
         limit: int = RUN_WORDS) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Yield ``(words, ids, ends)`` for runs of consecutive texts; null counts as empty.

    ``words`` are the distinct words of the run, ``ids`` the words of all its texts as positions in
    that list, ``ends`` where each text ends in ``ids``. No text is ever cut short.
    """
    numbers, parts, ends, total = _Numbered(), [], [], 0
    for text in texts:
        found = cut(text) if text else []
        parts.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
        total += len(found)
        ends.append(total)
        if len(numbers) >= limit or total >= 16 * limit:
            yield list(numbers), np.concatenate(parts), np.array(ends)
            numbers, parts, ends, total = _Numbered(), [], [], 0
    if ends:
        yield list(numbers), np.concatenate(parts), np.array(ends)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices of ``values`` (along its first axis) that end at ``ends``."""
    starts = np.concatenate(([0], ends[:-1]))
    out = np.zeros((len(ends), *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(ends > starts)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out
