"""Statistics of whole texts, computed with numpy over batches of texts.

Used by the quality classifier and by the quality rules. All functions are linear in the length of
the texts; a batch is worked on in parts of about ``PART_CHARS`` characters.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa

from plaudit.llm.common import chunks, texts_of

PART_CHARS = 1_000_000
WORD = re.compile("[^ \t-\r]+")
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8

# Classes of characters, by code point below 1024; all others count as letters of no case.
CLASSES = ("other", "lower", "upper", "digit", "blank", "newline", "stop", "exclaim", "symbol", "pipe")
_TABLE = np.zeros(1024, np.uint8)
for _code in range(1024):
    _char = chr(_code)
    _TABLE[_code] = (1 if _char.islower() else 2 if _char.isupper() else 3 if _char.isdigit() else 5 if _char == "\n"
                     else 4 if _char in BLANKS else 6 if _char in ".,;:?" else 7 if _char == "!"
                     else 9 if _char == "|" else 8 if _char in "#*$%&<>" else 0)

COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SHAPES = ("log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "pipe", "exclaim", "stop", "lines",
          "distinct", "top_word", "twice", "repeated", "dup_lines", "entropy")


def line_counts(text: str) -> tuple[int, int]:
    """Lines that hold a word, and those of them that equal an earlier line."""
    seen, worded = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            worded += 1
            seen.add(line)
    return worded, worded - len(seen)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of pairs, equal where the pairs are equal."""
    return pd.factorize(first * (int(second.max()) + 1) + second)[0].astype(np.int64)


def repeated_positions(words: np.ndarray, group: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks the words in windows of ``window`` (a power of two) words found twice or more in their group."""
    marked = np.zeros(len(words), bool)
    if len(words) < window:
        return marked
    key, span = words, 1
    while span < window:
        key = _joined(key[:len(key) - span], key[span:])
        span *= 2
    inside = group[:len(key)] == group[window - 1:]
    places = np.flatnonzero(inside)
    if not len(places):
        return marked
    number = _joined(key[places], group[places])
    found = places[np.bincount(number)[number] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _part(texts: list[str]) -> dict[str, np.ndarray]:
    n = len(texts)
    chars = np.fromiter(map(len, texts), np.int64, n)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _TABLE[np.minimum(codes, 1023)]
    kinds[codes > 1023] = 0
    owner = np.repeat(np.arange(n), chars)
    by_kind = np.bincount(owner * len(CLASSES) + kinds, minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
    kind = dict(zip(CLASSES, by_kind.T))
    words = [WORD.findall(text) for text in texts]
    count = np.fromiter(map(len, words), np.int64, n)
    flat = [word for some in words for word in some]
    group = np.repeat(np.arange(n), count)
    length = np.fromiter(map(len, flat), np.float64, len(flat))
    lines = np.array([line_counts(text) for text in texts], np.int64).reshape(n, 2)
    total = np.maximum(count, 1).astype(float)
    out = {"n_chars": chars, "n_words": count, "word_chars": np.bincount(group, length, n).astype(np.int64),
           "n_symbols": (kind["symbol"] + kind["pipe"]).astype(np.int64), "n_lines": lines[:, 0], "n_dup_lines": lines[:, 1]}
    mean = out["word_chars"] / total
    distinct, top, entropy, twice = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    repeats = np.zeros(n, np.int64)
    if flat:
        number = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64)
        pair = pd.factorize(number * n + group)[0]
        uses = np.bincount(pair)
        first = np.flatnonzero(np.r_[True, pair[1:] > np.maximum.accumulate(pair)[:-1]])  # in order of appearance
        home = group[first]
        distinct = np.bincount(home, minlength=n).astype(float)
        starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        top[home[starts]] = np.maximum.reduceat(uses, starts)
        entropy = np.log(total) - np.bincount(home, uses * np.log(uses), n) / total
        same = (number[1:] == number[:-1]) & (group[1:] == group[:-1])
        twice = np.bincount(group[1:], same, n)
        repeats = np.bincount(group, repeated_positions(number, group), n).astype(np.int64)
    out["n_repeat_words"] = repeats
    per_char = np.maximum(chars, 1).astype(float)
    out |= {
        "log_words": np.log1p(count), "mean_word": np.log1p(mean),
        "sd_word": np.sqrt(np.maximum(np.bincount(group, length**2, n) / total - mean**2, 0)) / np.maximum(mean, 1),
        "upper": kind["upper"] / per_char, "digit": np.sqrt(kind["digit"] / per_char),
        "symbol": np.sqrt(kind["symbol"] / total), "pipe": np.sqrt(kind["pipe"] / total),
        "exclaim": np.sqrt(kind["exclaim"] / total), "stop": kind["stop"] / total,
        "lines": np.sqrt(lines[:, 0] / total), "distinct": distinct / total ** 0.8, "top_word": top / total,
        "twice": np.sqrt(twice / total), "repeated": repeats / total,
        "dup_lines": lines[:, 1] / np.maximum(lines[:, 0], 1),
        "entropy": entropy / np.log(np.maximum(total, 2)),
    }
    return out


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """``COUNTS`` and ``SHAPES`` of each text; a text without words has zeros throughout."""
    parts = [_part(texts[part]) for part in chunks(texts, PART_CHARS)]
    names = (*COUNTS, *SHAPES)
    if not parts:
        return {name: np.zeros(0) for name in names}
    return {name: np.concatenate([part[name] for part in parts]) for name in names}


def statistics_of(column: pa.Array, rows: int = 512) -> dict[str, np.ndarray]:
    """``statistics`` of a column of texts, some rows at a time: the texts are never all held as Python objects."""
    parts = [statistics(texts_of(column.slice(at, rows).to_pylist())) for at in range(0, max(len(column), 1), rows)]
    return {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}


def matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([stats[name] for name in SHAPES]).astype(np.float64)
