"""Best-fit packing of tokenised documents by length patterns.

Lengths are counted first. Patterns of a few lengths that fill a sequence exactly are enumerated, a
non-negative least-squares fit of their repeat counts to the histogram is rounded and laid out, again and again
on what is left, and the rest goes by best fit, longest lengths first, many equal sequences at a time. All of
this works on a histogram of ``capacity`` numbers, whatever the data. Pieces then find their place by their rank among
the pieces of their length: ranks count on from task to task, so a frequent length is spread over all tasks.

Cases: a null or empty text still has its end id; texts longer than a sequence are cut so that all pieces but the
first are full; a repeated row is packed as often as it stands there; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaudit.llm.common import chunks, documents, texts_of, written
from plaudit.llm.library_tokens import spaced_memory
from plaudit.llm.segments import PART_CHARS

CAPACITY = 2048
END_ID = 0


@dataclass(frozen=True)
class PackOptions:
    capacity: int = CAPACITY
    rounds: int = 2                 # of enumeration, fit and rounding
    patterns: int = 30_000          # in a round, about
    steps: int = 250                # of the fit
    weight: float = 2.0             # power of the length in the fit
    seed: int = 5


Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, times) ...), number of equal sequences


def exact_patterns(hist: np.ndarray, capacity: int, wanted: int, rng: np.random.Generator) -> np.ndarray:
    """Distinct rows of four lengths (0 for none) that are there and sum to the capacity.

    Each length there is the start of all its pairs and of about equally many threes and fours, whose further
    lengths are drawn from the histogram as far as they still fit.
    """
    there = np.flatnonzero(hist)
    if not len(there):
        return np.zeros((0, 4), np.int64)
    up_to = np.cumsum(hist)
    rows = [np.pad(np.column_stack([there, capacity - there]), ((0, 0), (0, 2)))]
    for drawn in (1, 2):
        part = np.repeat(there, -(-wanted // len(there)))[:, None]
        for _ in range(drawn):
            room = np.maximum(capacity - part.sum(axis=1), 0)
            part = np.column_stack([part, np.searchsorted(up_to, rng.random(len(part)) * up_to[room], "right")])
        rows.append(np.pad(np.column_stack([part, capacity - part.sum(axis=1)]), ((0, 0), (0, 2 - drawn))))
    rows = np.concatenate(rows)
    rows = rows[(rows >= 0).all(axis=1) & (rows < capacity).all(axis=1)]
    rows = rows[((rows == 0) | (hist[rows] > 0)).all(axis=1)]
    return np.unique(np.sort(rows, axis=1)[:, ::-1], axis=0)


def fitted_counts(rows: np.ndarray, hist: np.ndarray, steps: int, power: float) -> np.ndarray:
    """Non-negative counts x of the patterns, by accelerated projected gradient.

    They have the least weighted squares of (uses of each length - histogram). Long pieces weigh more: what is left of
    them packs badly, what is left of short ones packs well.
    """
    size = len(hist)
    want, weight = hist.astype(float), (np.arange(size) / size) ** power
    want[0] = weight[0] = 0
    load = np.bincount(rows.ravel(), minlength=size) * weight
    # The curvature along a pattern is at most the sum over its lengths of what all patterns put on them.
    scale = 1.0 / np.maximum(load[rows].sum(axis=1), 1e-12)
    x = np.zeros(len(rows))
    ahead, momentum = x, 1.0
    for _ in range(steps):
        used = np.bincount(rows.ravel(), np.repeat(ahead, rows.shape[1]), size)
        fresh = np.maximum(ahead - scale * ((used - want) * weight)[rows].sum(axis=1), 0)
        follow = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, x, momentum = fresh + (momentum - 1) / follow * (fresh - x), fresh, follow
    return x


def _grouped(lengths: list[int]) -> tuple[tuple[int, int], ...]:
    found: dict[int, int] = {}
    for length in lengths:
        found[length] = found.get(length, 0) + 1
    return tuple(found.items())


def best_fit(hist: np.ndarray, capacity: int) -> list[Group]:
    """Best fit, longest first, with equal sequences treated as one group."""
    open_groups: dict[int, list[Group]] = {}
    free_sizes = np.zeros(capacity + 1, bool)
    done: list[Group] = []

    def put(free: int, group: Group) -> None:
        if free == 0:
            done.append(group)
        else:
            open_groups.setdefault(free, []).append(group)
            free_sizes[free] = True

    for length in np.flatnonzero(hist)[::-1].tolist():
        left = int(hist[length])
        while left:
            fitting = np.flatnonzero(free_sizes[length:])
            if not len(fitting):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (((length, each),), left // each))
                if left % each:
                    put(capacity - left % each * length, (((length, left % each),), 1))
                break
            free = int(fitting[0]) + length
            pattern, count = open_groups[free].pop()
            if not open_groups[free]:
                free_sizes[free] = False
            each = min(free // length, left)             # so many into each sequence
            used = min(count, left // each)
            put(free - each * length, ((*pattern, (length, each)), used))
            if count > used:
                put(free, (pattern, count - used))
            left -= used * each
    return done + [group for groups in open_groups.values() for group in groups]


def packing_plan(hist: np.ndarray, options: PackOptions = PackOptions()) -> list[Group]:
    """Groups of equal sequences that hold all pieces of the histogram (index: length, up to the capacity)."""
    left, capacity = hist.astype(np.int64).copy(), options.capacity
    plan: list[Group] = []
    if left[capacity]:
        plan.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    rng = np.random.default_rng(options.seed)
    for _ in range(options.rounds):
        rows = exact_patterns(left, capacity, options.patterns, rng)
        if not len(rows):
            break
        counts = fitted_counts(rows, left, options.steps, options.weight)
        for at in np.argsort(-counts, kind="stable"):
            if counts[at] < 0.5:
                break
            pattern = _grouped([int(length) for length in rows[at] if length])
            n = min(int(round(counts[at])), *(int(left[length]) // times for length, times in pattern))
            if n:
                plan.append((pattern, n))
                for length, times in pattern:
                    left[length] -= n * times
    return plan + best_fit(left, capacity)


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, hist: np.ndarray, plan: list[Group]) -> None:
        self.before = np.r_[0, np.cumsum(hist)]
        at_rank = self.before[:-1].copy()
        rows, sequence = [], 0
        for pattern, count in plan:
            offset = 0
            for length, times in pattern:
                rows.append((at_rank[length], sequence, offset, times, length))
                at_rank[length] += count * times
                offset += length * times
            sequence += count
        assert (at_rank == self.before[1:]).all()
        self.sequences = sequence
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.before[length] + rank
        row = self.rows[np.searchsorted(self.rows[:, 0], place, "right") - 1]
        at = place - row[:, 0]
        return row[:, 1] + at // row[:, 3], row[:, 2] + at % row[:, 3] * row[:, 4]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long"


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``PIECES`` of all texts; ``part_rank`` counts the pieces of one length within a task."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, part = spaced_memory(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts, docs_of = texts_of(batch["text"]), batch["doc_id"]
            for some in chunks(texts, PART_CHARS):
                ids, counts = memory.ids(texts[some])
                ids, total = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4"), counts + 1
                n = -(-total // capacity)
                owner = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                first = total - (n - 1) * capacity
                length = np.where(piece == 0, first[owner], capacity)
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                ends = np.cumsum(length)
                stream = memoryview(ids.tobytes())
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = seen[ordered] + np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
                seen += np.bincount(length, minlength=capacity + 1)
                yield pd.DataFrame({
                    "doc_id": docs_of.iloc[some].iloc[owner].to_numpy(), "piece": piece.astype(np.int32), "start": start, "length": length,
                    "ids_crc32": [zlib.crc32(stream[4 * (end - size):4 * end]) for end, size in zip(ends.tolist(), length.tolist())],
                    "part": np.int32(part), "part_rank": rank})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


def packed(spark: SparkSession, docs: DataFrame, path: str, options: PackOptions = PackOptions()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces."""
    pieces = written(spark, pieces_of(docs, path, options.capacity), "pieces")
    spans = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = np.zeros(options.capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row per length
        hist[row["length"]] = row["n"]
    places = Places(hist, packing_plan(hist, options))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_start"))
    ranked = pieces.join(starts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank_start") + F.col("part_rank")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = places.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packed(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
