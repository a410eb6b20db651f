"""Suffix arrays of shards by induced sorting, in numpy: whole buckets are induced at once.

``suffix_array`` classifies suffixes as smaller (S) or larger (L) than their next one, sorts the leftmost S-type substrings by
inducing, names them, orders the names, and induces the order of all suffixes from theirs. Scanning a bucket moves
the predecessors of all its suffixes at once to their own buckets (a stable sort by first letter keeps their order); a bucket that
feeds itself is scanned again from where it grew. Names are ordered by the same function while they are few for their number;
else their order comes from doubling, as a bucket per name would leave nothing to do at once.

``common_prefixes`` gives the permuted prefix array: how many letters each suffix shares with the one before it in order.
From position to position this falls by one at most, so each of many lanes of the text walks on from what it knows.
"""

from __future__ import annotations

import numpy as np

FEW_NAMES = 256     # names are sorted recursively if there are as many times more of them than different ones
LANE = 64


def sorted_by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of names by ranks of twice as many names each round."""
    size, rank, width = len(names), names.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[:size - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        width *= 2
        if rank[order[-1]] == size - 1 or width >= size:
            return order


def induced(text: np.ndarray, letters: int, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes, given the leftmost S-type ones in order (or, to sort their substrings, as they come)."""
    counts = np.bincount(text, minlength=letters)
    ends = np.cumsum(counts)
    heads = ends - counts
    array = np.full(len(text), -1, np.int32)
    first = text[seeds]
    by_letter = seeds[np.argsort(first, kind="stable")]
    seeded = np.bincount(first, minlength=letters)
    into = np.repeat(ends - seeded - (np.cumsum(seeded) - seeded), seeded) + np.arange(len(seeds))
    array[into] = by_letter
    used = np.flatnonzero(counts)

    def move(block: np.ndarray, want: bool, pointer: np.ndarray, step: int) -> None:
        before = block[block > 0] - 1
        before = before[smaller[before] == want]
        if not len(before):
            return
        letter = text[before]
        order = np.argsort(letter, kind="stable")
        letter, before = letter[order], before[order]
        starts = np.flatnonzero(np.r_[True, letter[1:] != letter[:-1]])
        lengths = np.diff(np.r_[starts, len(letter)])
        place = np.arange(len(letter)) - np.repeat(starts, lengths)
        own = letter[starts]
        if step > 0:
            array[np.repeat(pointer[own], lengths) + place] = before
            pointer[own] += lengths
        else:
            array[np.repeat(pointer[own], lengths) - 1 - place] = before
            pointer[own] -= lengths

    filled = heads.copy()
    for letter in used:
        done = heads[letter]
        while done < filled[letter]:
            block = array[done:filled[letter]]
            done = filled[letter]
            move(block, False, filled, 1)
        move(array[ends[letter] - seeded[letter]:ends[letter]], False, filled, 1)
    opened = ends.copy()
    for letter in used[::-1]:
        done = ends[letter]
        while done > opened[letter]:
            block = array[opened[letter]:done][::-1]
            done = opened[letter]
            move(block, True, opened, -1)
        move(array[heads[letter]:filled[letter]][::-1], True, opened, -1)
    array[0] = len(text) - 1
    return array


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of whole numbers below ``letters``; the last one must be 0 and the only 0."""
    size = len(text)
    if size == 1:
        return np.zeros(1, np.int32)
    differs = text[:-1] != text[1:]
    decided = np.where(differs, np.arange(size - 1), size)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = np.ones(size, bool)
    smaller[:-1] = text[decided] < text[decided + 1]
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    array = induced(text, letters, smaller, leftmost)
    if len(leftmost) < 2:
        return array
    is_leftmost = np.zeros(size, bool)
    is_leftmost[leftmost] = True
    ordered = array[is_leftmost[array]].astype(np.int64)
    # Names: substrings up to the next leftmost position, equal ones share a name.
    span = np.zeros(size, np.int64)
    span[leftmost] = np.diff(np.r_[leftmost, size - 1]) + 1
    lengths = span[ordered]
    alike = np.r_[False, lengths[1:] == lengths[:-1]]
    pairs = np.flatnonzero(alike)
    tested = lengths[pairs]
    offsets = np.arange(tested.sum()) - np.repeat(np.cumsum(tested) - tested, tested)
    left, right = np.repeat(ordered[pairs - 1], tested) + offsets, np.repeat(ordered[pairs], tested) + offsets
    unlike = text[np.minimum(left, size - 1)] != text[np.minimum(right, size - 1)]
    alike[pairs] = np.add.reduceat(unlike, np.cumsum(tested) - tested) == 0 if len(pairs) else False
    names = np.cumsum(~alike) - 1
    different = int(names[-1]) + 1
    if different < len(leftmost):
        name_of = np.zeros(size, np.int64)
        name_of[ordered] = names
        reduced = name_of[leftmost]
        by_name = suffix_array(reduced, different) if different * FEW_NAMES <= len(reduced) else sorted_by_doubling(reduced)
        ordered = leftmost[by_name]
    return induced(text, letters, smaller, ordered)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters (up to ``most``) each suffix shares with the suffix before it in order, and that suffix (-1: none)."""
    size = len(text)
    previous = np.full(size, -1, np.int64)
    previous[array[1:]] = array[:-1]
    padded = np.r_[text, np.full(most + 1, -1, text.dtype)]
    shared = np.zeros(size, np.int32)
    lanes = np.arange(0, size, LANE)
    known = np.zeros(len(lanes), np.int64)
    for step in range(LANE):
        at = lanes + step
        if at[-1] >= size:
            lanes, at, known = lanes[:-1], at[:-1], known[:-1]
            if not len(at):
                break
        other = previous[at]
        known = np.where(other >= 0, np.maximum(known - 1, 0), 0)
        walking = np.flatnonzero((other >= 0) & (known < most))
        while len(walking):
            same = padded[at[walking] + known[walking]] == padded[other[walking] + known[walking]]
            walking = walking[same]
            known[walking] += 1
            walking = walking[known[walking] < most]
        shared[at] = known
    return shared, previous
