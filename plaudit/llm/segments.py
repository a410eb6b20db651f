"""Token ids of texts through a memory of the segments already encoded.

A text is cut into segments whose ids do not depend on their surroundings; each new segment is encoded once
per Python worker, and ids are put together by numpy. The memory holds about ``MAX_SEGMENTS`` segments; when
it is full it keeps the more frequent third, which changes nothing but speed.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

from plaudit.llm.common import chunks

MAX_SEGMENTS = 600_000
PART_CHARS = 1_000_000


def taken(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + length]`` one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    places = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
    return flat[places]


class SegmentMemory:
    """``encode``: segments to their id lists; ``cut``: a text to its segments."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.cut, self.encode = cut, encode
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 14, kind) for kind in (np.int64, np.int32, np.int32))

    def _add(self, fresh: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, last = len(self.number), len(self.number) + len(fresh)
        while last > len(self.starts):
            self.starts, self.lengths, self.uses = (np.r_[own, np.zeros_like(own)] for own in (self.starts, self.lengths, self.uses))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, self.flat]
        self.flat[self.used:self.used + len(ids)] = ids
        self.lengths[first:last] = lengths
        self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.number.update(zip(fresh, range(first, last)))

    def _forget(self) -> None:
        """Keeps the segments used most, a third of the bound at most, and halves their counts."""
        known = len(self.number)
        uses = self.uses[:known]
        least = np.partition(uses, known - MAX_SEGMENTS // 3)[known - MAX_SEGMENTS // 3]
        places = np.flatnonzero(uses > least)
        segments = list(self.number)
        kept = [segments[at] for at in places.tolist()]
        starts, lengths, counts = self.starts[places], self.lengths[places].astype(np.int64), uses[places] // 2
        flat = taken(self.flat, starts, lengths)
        self.clear()
        if kept:
            self._add(kept, flat, lengths)
            self.uses[:len(kept)] = counts

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part in chunks(texts, PART_CHARS):
            cut = [self.cut(text) for text in texts[part]]
            if len(self.number) > MAX_SEGMENTS:
                self._forget()
            flat = list(chain.from_iterable(cut))
            numbers = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
            missing = np.flatnonzero(numbers < 0).tolist()
            if missing:
                unknown = [flat[at] for at in missing]
                fresh = list(dict.fromkeys(unknown))
                self._add(fresh, *self.encode(fresh))
                numbers[missing] = [self.number[segment] for segment in unknown]
            self.uses[:len(self.number)] += np.bincount(numbers, minlength=len(self.number)).astype(np.int32)
            per_text = np.fromiter(map(len, cut), np.int64, len(cut))
            lengths = self.lengths[numbers]
            parts.append(taken(self.flat, self.starts[numbers], lengths))
            owner = np.repeat(np.arange(len(cut)), per_text)
            counts.append(np.bincount(owner, lengths, len(cut)).astype(np.int64))
        return np.concatenate(parts), np.concatenate(counts)


FIRST = "\0"  # marks a segment that no space precedes


def cut_at_spaces(text: str) -> list[str]:
    """Segments that a single space precedes, for patterns that tie at most one space to what follows.

    The space is left out; the first segment has none and is marked. Texts with runs of spaces, with the mark itself, or with a
    blank at either end, are one segment.
    """
    if "  " in text or FIRST in text or text[:1].isspace() or text[-1:].isspace():
        return [FIRST + text]
    if not text:
        return []
    segments = text.split(" ")
    segments[0] = FIRST + segments[0]
    return segments


def spaced(segment: str) -> str:
    """The text of a segment of ``cut_at_spaces``."""
    return segment[1:] if segment[:1] == FIRST else " " + segment
