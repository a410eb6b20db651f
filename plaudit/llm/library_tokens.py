"""Token ids of the tokenizers library, with a memory of the segments already encoded.

The library's cost per character lies in its normaliser and its pattern, so words of plain Latin
letters, whose normal form and pieces are known, are handed to the library's model alone; every other segment
goes through the whole tokenizer. So do texts that spell out a special token, undivided: the library's ids for them, by
its default, are those of the token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

from plaudit.llm.segments import FIRST, SegmentMemory, cut_at_spaces, spaced, taken

AT_ONCE = 4_000
TOGETHER = 64                 # words in one text for the model
BREAK = FIRST + "\n"           # begins a segment that a line end precedes, and no space
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?|#$%&*"
_M = re.escape(MARKS)
SPACED = re.compile(f"( ?[{LETTERS}]+)([{_M}]+)?(?:(\n)([{LETTERS}]+)([{_M}]+)?)?|( ?[{_M}]+)")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + at) for at, byte in enumerate(rest)}


_BYTES = byte_letters()
SPACE, LINE_END, WORD_END = _BYTES[32], _BYTES[10], "</w>"
PARTING = "\x01"               # between words for the model; no word has it, nor the blank it is written as
_BY_BYTE = np.array([ord(" " if byte == ord(PARTING) else _BYTES[byte]) for byte in range(256)], "<u4")
_BY_CHAR = {code: "".join(_BYTES[byte] for byte in chr(code).encode()) for code in range(256)}


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class LibraryEncoder:
    def __init__(self, path: str, words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.parted = Tokenizer(self.whole.model)
        self.parted.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.words = words
        # Tokens at a border of a word: those that end one, or those that carry the space or the line end before one.
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)
        self.border[[number for token, number in vocabulary.items() if (token.endswith(WORD_END) if words else token.startswith((SPACE, LINE_END)))]] = True
        self.tails: dict[str, np.ndarray] = {}
        added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        # In any case: lower case must not make a token of what is none.
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        # What has no case in them; looking for it first is much cheaper.
        self.hints = {max(re.split(r"[^\W_]+", token), key=len) for token in added}

    def memory(self, cut: Callable[[str], list[str]]) -> SegmentMemory:
        """A memory of the segments of ``cut``; a text with a special token is one, as the token also parts what stands around it."""
        def cut_text(text: str) -> list[str]:
            if any(hint in text for hint in self.hints) and self.special.search(text):
                return [text if self.words else FIRST + text]
            return cut(text)

        return SegmentMemory(cut_text, self.encode)

    def pieces(self, segment: str) -> tuple[str, ...] | None:
        """The pieces that the tokenizer's pattern makes of a segment of several words and marks."""
        if self.words or not segment.rstrip(MARKS):
            return None
        found = SPACED.fullmatch(spaced(segment))
        return tuple(filter(None, found.groups())) if found else None

    def by_model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has, by the model alone; one result for many pieces is much cheaper than one for each."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for begin in range(0, len(pieces), AT_ONCE):
            some = pieces[begin:begin + AT_ONCE]
            result = self.model.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(result.ids, np.int32))
            sizes.append(np.bincount(np.array(result.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(sizes)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words as they stand, with the blank before them, whose borders the tokens tell, so that the library need not
        keep track of them. Many words make one text for the model, as each text costs more than a word does."""
        blocks = (PARTING.join(words[begin:begin + TOGETHER]).encode() for begin in range(0, len(words), TOGETHER))
        texts = [_BY_BYTE[np.frombuffer(block, np.uint8)].tobytes().decode("utf-32-le") for block in blocks]
        results = self.parted.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(result.ids, np.int32) for result in results)])
        borders = np.flatnonzero(self.border[ids])
        if len(borders) != len(words):                          # a vocabulary without such tokens
            parts = [word.split(PARTING) for word in words]
            ids, sizes = self.by_model([part.translate(_BY_CHAR) for part in chain.from_iterable(parts)])
            return ids, np.bincount(np.repeat(np.arange(len(parts)), list(map(len, parts))), sizes, len(parts)).astype(np.int64)
        return ids, np.diff(np.r_[-1, borders] if self.words else np.r_[borders, len(ids)])

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and how many each has.

        Most segments are a word of plain letters, perhaps with marks behind it: the words go to the model at once, runs of marks
        are remembered. Other plain segments are cut into the pieces the tokenizer's pattern makes of them; the rest goes to the tokenizer.
        """
        own, words, tails, others = [], [], [], []
        for at, segment in enumerate(segments):
            stem = body = segment.rstrip(MARKS)
            if stem[:1] == FIRST and stem[:2] == BREAK and not self.words:
                body = stem[2:]
            if body.isalpha() and (body.isascii() or is_latin(body)):
                own.append(at)
                words.append(body.lower() if self.words else " " + body if body is stem else "\n" + PARTING + body)
                tails.append(segment[len(stem):])
            else:
                others.append(at)
        fresh = list(dict.fromkeys(tail for tail in tails if tail and tail not in self.tails))
        for tail, ids in zip(fresh, self._split(*self.by_model([tail.translate(_BY_CHAR) for tail in fresh]))):
            self.tails[tail] = ids
        number = {"": -1} | {tail: at for at, tail in enumerate(self.tails)}
        word_ids, word_sizes = self.of_words(words)
        other_ids, other_sizes = self.encode_others([segments[at] for at in others])
        # Units: the words, the other segments, the runs of marks. A segment is one unit, or a word and its marks.
        flat = np.concatenate([word_ids, other_ids, *self.tails.values()])
        sizes = np.concatenate([word_sizes, other_sizes, np.fromiter(map(len, self.tails.values()), np.int64, len(self.tails))]).astype(np.int64)
        places = np.cumsum(sizes) - sizes
        tail = np.full(len(segments), -1, np.int64)
        unit = np.empty(len(segments), np.int64)
        tail[own] = np.fromiter(map(number.__getitem__, tails), np.int64, len(tails))
        unit[own] = np.arange(len(own))
        unit[others] = len(own) + np.arange(len(others))
        per = 1 + (tail >= 0)
        first = np.cumsum(per) - per
        uses = np.empty(int(per.sum()), np.int64)
        uses[first] = unit
        uses[first[tail >= 0] + 1] = len(segments) + tail[tail >= 0]
        lengths = sizes[unit]
        lengths[tail >= 0] += sizes[len(segments) + tail[tail >= 0]]
        return taken(flat, places[uses], sizes[uses]), lengths

    @staticmethod
    def _split(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def encode_others(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for segments that are no single word; each distinct piece goes to the model once."""
        pieces = [self.pieces(segment) for segment in segments]
        rest = [segment if self.words else spaced(segment) for segment, some in zip(segments, pieces) if some is None]
        number = {piece: at for at, piece in enumerate(set(chain.from_iterable(filter(None, pieces))))}
        ids, sizes = self.by_model([piece.translate(_BY_CHAR) for piece in number])
        ids, sizes = [ids], [sizes]
        for result in self.whole.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.array(result.ids, np.int32))
            sizes.append([len(result.ids)])
        flat = np.concatenate(ids)
        sizes = np.concatenate(sizes).astype(np.int64)
        places = np.cumsum(sizes) - sizes
        others = iter(range(len(number), len(sizes)))
        per = np.fromiter((1 if some is None else len(some) for some in pieces), np.int64, len(pieces))
        uses = np.fromiter(chain.from_iterable((next(others),) if some is None else map(number.__getitem__, some) for some in pieces),
                           np.int64, int(per.sum()))
        return taken(flat, places[uses], sizes[uses]), np.bincount(np.repeat(np.arange(len(per)), per), sizes[uses], len(per)).astype(np.int64)


def cut_words(text: str) -> list[str]:
    """The runs between spaces and line ends; lower case where that is the same letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    return text.lower().replace("\n", " ").split(" ")


def cut_at_blanks(text: str) -> list[str]:
    """The segments of ``cut_at_spaces``, cut at single line ends as well if no other blank stands beside any."""
    if "\n" not in text or FIRST in text or "  " in text:
        return cut_at_spaces(text)
    if not all(line and not line[0].isspace() and not line[-1].isspace() for line in text.split("\n")):
        return cut_at_spaces(text)
    segments = text.replace("\n", " " + BREAK).split(" ")
    segments[0] = FIRST + segments[0]
    return segments


@cache
def word_memory(path: str) -> SegmentMemory:
    """For vocabularies with word ends, which drop blanks: see ``cut_words``."""
    return LibraryEncoder(path, words=True).memory(cut_words)


@cache
def spaced_memory(path: str) -> SegmentMemory:
    """For byte-level vocabularies, which tie a space to the word behind it."""
    return LibraryEncoder(path, words=False).memory(cut_at_blanks)
