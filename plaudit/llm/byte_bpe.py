"""Byte-level BPE: encoding by rank merges in padded numpy matrices, and decoding.

Pieces of the pattern are grouped by their length in bytes into matrices of part numbers. In each round every row finds
its leftmost pair of minimum rank in a hashed table of pairs, merges it and closes the gap, until no row
has a pair with a rank. Pairs are numbered by the ranks of their parts, so the lookup needs no text.
Segments seen before come from a bounded memory per worker, which holds results of this encoder only.

Cases: a null text counts as empty and has no ids; a repeated row is encoded as often as it stands there; a
text of any length is one piece of work without a limit, a long piece of the pattern is one row of its matrix.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from plaudit.llm.common import chunks, documents, texts_of
from plaudit.llm.segments import PART_CHARS, SegmentMemory, cut_at_spaces, spaced, taken

NONE = np.int32(2**31 - 1)
ROWS = 1 << 11                # of a matrix at most: it stays in the cache
CELLS = 1 << 21               # of a matrix at most, unless a single piece is longer


class PairTable:
    """Open-addressing hash table from pairs of part ids to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slots, waiting = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = self.keys[slots[waiting]] == -1
            self.keys[slots[waiting[free]]] = keys[waiting[free]]      # of several, the last one stays
            placed = self.keys[slots[waiting]] == keys[waiting]
            self.values[slots[waiting[placed]]] = merged[waiting[placed]]
            waiting = waiting[~placed]
            slots[waiting] = (slots[waiting] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where a pair does not merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        flat, result = keys.ravel(), out.ravel()
        open_places = np.arange(len(flat))
        slots = self._slot(flat)
        for _ in range(self.probes):
            seen = self.keys[slots]
            hit = seen == flat[open_places]
            result[open_places[hit]] = self.values[slots[hit]]
            on = ~hit & (seen != -1)
            if not on.any():
                break
            open_places, slots = open_places[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out


class RankBpe:
    """Encoder and decoder of a rank file: the rank of a token is its id and the order of its merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([byte])] for byte in range(256)], np.int32)
        pairs = [(ranks[token[:at]], ranks[token[at:]], rank) for token, rank in ranks.items() for at in range(1, len(token))
                 if token[:at] in ranks and token[at:] in ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        # Any cut of a token into two tokens may come up, and all have the rank of the token.
        self.table = PairTable(left, right, merged.astype(np.int32))
        tokens = [self.token.get(at, b"") for at in range(max(self.token, default=-1) + 1)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.places = np.cumsum(self.sizes) - self.sizes

    def _merged(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part ids of equally long rows after all merges, padded with -1, and how many each row has."""
        n, width = parts.shape
        done = np.full((n, width), -1, np.int32)
        rows, parts = np.arange(n), parts.copy()
        ranks = self.table.find(parts[:, :-1], parts[:, 1:]) if width > 1 else np.zeros((n, 0), np.int32)
        while width > 1 and len(rows):
            best = ranks.argmin(axis=1)                      # the leftmost of equal ranks
            each = np.arange(len(rows))
            rank = ranks[each, best]
            ended = rank == NONE
            if ended.any():
                done[rows[ended], :width] = parts[ended]
                go = ~ended
                rows, parts, ranks, best, rank, each = rows[go], parts[go], ranks[go], best[go], rank[go], each[:go.sum()]
                if not len(rows):
                    break
            parts[each, best] = rank
            keep = np.arange(width) != (best + 1)[:, None]   # close the gap
            parts = parts[keep].reshape(len(rows), width - 1)
            ranks = np.delete(ranks, 0, axis=1) if width == 2 else ranks[np.arange(width - 1) != best[:, None]].reshape(len(rows), width - 2)
            width -= 1
            if width > 1:                                    # only the pairs beside the merge are new
                for side in (-1, 0):
                    at = best + side
                    fits = (at >= 0) & (at < width - 1)
                    r, c = each[fits], at[fits]
                    left, right = parts[r, c], parts[r, c + 1]
                    found = self.table.find(left, right)
                    found[(left < 0) | (right < 0)] = NONE
                    ranks[r, c] = found
        if len(rows):
            done[rows, :width] = parts
        return done, (done >= 0).sum(axis=1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        counts = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes[sizes > 0]):
            same = np.flatnonzero(sizes == size)
            step = int(max(1, min(ROWS, CELLS // size)))
            for begin in range(0, len(same), step):
                rows = same[begin:begin + step]
                ids, n = self._merged(flat[starts[rows][:, None] + np.arange(size)])
                counts[rows] = n
                found.append((rows, ids, n))
        out = np.zeros(int(counts.sum()), np.int32)
        at = np.cumsum(counts) - counts
        for rows, ids, n in found:
            inside = ids >= 0
            out[(at[rows][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        return out, counts

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for segments of ``cut_at_spaces``, each of any number of pieces."""
        pieces = [self.pattern.findall(spaced(segment)) for segment in segments]
        per = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, counts = self.encode_pieces([piece.encode("utf-8", "replace") for some in pieces for piece in some])
        return ids, np.bincount(np.repeat(np.arange(len(per)), per), counts, len(per)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return taken(self.bytes, self.places[ids], self.sizes[ids]).tobytes()


@cache
def rank_bpe(path: str, pattern: str) -> RankBpe:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return RankBpe(ranks, pattern)


@cache
def segment_memory(path: str, pattern: str) -> SegmentMemory:
    bpe = rank_bpe(path, pattern)
    return SegmentMemory(cut_at_spaces, bpe.encode_segments)


@cache
def decimals(top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers below ``top`` as decimal text with a space behind: bytes, places, sizes."""
    texts = [b"%d " % number for number in range(top)]
    sizes = np.fromiter(map(len, texts), np.int64, top)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every row."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = segment_memory(path, pattern)
        for batch in batches:
            ids, counts = memory.ids(texts_of(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": np.split(ids, np.cumsum(counts)[:-1]) if len(batch) else []})

    return docs.select("doc_id", "text").mapInPandas(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` from rows ``doc_id, ids``; an id without a token stands for no bytes."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = rank_bpe(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bytes": [bpe.decode(np.asarray(ids, np.int64)) for ids in batch["ids"]]})

    return rows.mapInPandas(decode, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of their decoded bytes, without moving either."""
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, bpe = segment_memory(path, pattern), rank_bpe(path, pattern)
        digits, digit_places, digit_sizes = decimals(len(bpe.sizes))
        for batch in batches:
            texts, counts, written, back = texts_of(batch["text"]), [], [], []
            for part in chunks(texts, PART_CHARS):
                ids, n = memory.ids(texts[part])
                ends = np.cumsum(n)
                for places, sizes, flat, out, cut in ((digit_places, digit_sizes, digits, written, 1), (bpe.places, bpe.sizes, bpe.bytes, back, 0)):
                    stream = memoryview(taken(flat, places[ids], sizes[ids]).tobytes())
                    bounds = np.r_[0, np.cumsum(sizes[ids])][np.r_[0, ends]]
                    out += [hashlib.sha256(stream[a:max(a, b - cut)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
                counts.append(n)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.concatenate(counts) if counts else [],
                                "ids_sha256": written, "decoded_sha256": back})

    return docs.select("doc_id", "text").mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
