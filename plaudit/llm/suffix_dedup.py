"""Repeated passages: every byte covered by a string of ``match`` bytes that starts earlier too goes, by suffix arrays of shards.

Shards are cut by content, so that equal strings meet in one of them wherever they come from:

1. Anchors. Of the ``anchor``-byte strings inside each window of ``match`` bytes the one with the least hash is the window's anchor:
   equal windows have equal anchors. The context of an anchor is the bytes of the windows it is the anchor of. Anchors are found with
   numpy, in parts of bounded size (very long texts in overlapping parts), about one for each 35 bytes; only hashes and places travel.
2. Of equal contexts all but the earliest are repeated as a whole. Within a part this is known at once, so that a text copied any
   number of times sends a few rows; the rest is grouped by Spark. Most anchors have one context, and need nothing else.
3. Anchors in different contexts (at the ends of passages, around edits): the earliest of each context sends its bytes. Shards of whole
   anchors, about ``shard_bytes`` each, get a suffix array by induced sorting and its permuted common prefixes (module
   ``suffix_arrays``); suffixes next to each other that share ``match`` bytes are one string, and all but its earliest place are repeated.
   An anchor in more than ``hot_contexts`` contexts, as at the ends of a passage that a third of all documents holds, would not fit a
   shard: its windows are compared by hashes of 128 bits instead, first within a batch, then by groups.
4. The repeated stretches go to their documents, whose texts are shuffled by id.

Defined cases: null text is the empty text. Documents are in the order of their ids, null ids last; those of one id by a hash of the
text; rows equal in id and text are one document, whose result each of them has. Texts are compared as UTF-8 bytes, so that what is
kept may cut a character. Texts shorter than ``match`` bytes lose nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaudit.llm.common import documents, written
from plaudit.llm.suffix_arrays import common_prefixes, suffix_array

LAST = (1 << 63) - 1        # the key of null ids
KEY = ["doc_key", "tie"]


@dataclass(frozen=True)
class DedupOptions:
    match: int = 100
    anchor: int = 32
    part_bytes: int = 1 << 20
    shard_bytes: int = 1 << 20
    hot_contexts: int = 512

    @property
    def reach(self) -> int:
        """Window starts before an anchor, beside its own."""
        return self.match - self.anchor


# Anchors --------------------------------------------------------------------------------------


class Hashes:
    """Hashes of all strings of a given length, from prefix sums of random numbers per byte times powers modulo 2^64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grown(self, size: int) -> None:
        while len(self.up) < size:
            have = len(self.up)
            self.up = np.r_[self.up, self.up * np.uint64(pow(self.base, have, 1 << 64))]
            self.down = np.r_[self.down, self.down * np.uint64(pow(self.inverse, have, 1 << 64))]

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grown(len(data) + 1)
        return np.r_[np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.down[:len(data)])]

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.up[starts])


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` values in a row, by doubling."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[:len(values) - rest], values[rest:]) if rest else values


class Part:
    """Pieces of texts, one after another: document, bytes, and where in the document they begin."""

    def __init__(self) -> None:
        self.pieces: list[tuple[tuple[int, int], bytes, int]] = []
        self.size = 0

    def add(self, doc: tuple[int, int], data: bytes, low: int) -> None:
        self.pieces.append((doc, data, low))
        self.size += len(data)


def parts_of(rows: Iterator[tuple[int, int, bytes]], options: DedupOptions) -> Iterator[Part]:
    """Parts of about ``part_bytes``; a longer text is cut into pieces that overlap by a window."""
    part, step, match = Part(), options.part_bytes, options.match
    for doc, tie, data in rows:
        for low in range(0, len(data) - match + 1, step):
            part.add((doc, tie), data[low:low + step + match - 1], low)
            if part.size >= step:
                yield part
                part = Part()
    if part.pieces:
        yield part


def repetitions(found: dict[str, np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    """Rows whose keys come at an earlier place among the rows; rows of the same place are one."""
    order = np.lexsort([found[name] for name in ("place", "tie", "doc_key", *keys[::-1])])
    ordered = {name: values[order] for name, values in found.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([ordered[name][1:] != ordered[name][:-1] for name in keys], axis=0)
    leader = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    late = np.zeros(len(order), bool)
    late[order] = np.any([ordered[name] != ordered[name][leader] for name in (*KEY, "place")], axis=0)
    return late


class AnchorFinder:
    def __init__(self, options: DedupOptions) -> None:
        self.options, self.first, self.second = options, Hashes(11), Hashes(12)

    def __call__(self, part: Part) -> dict[str, np.ndarray]:
        """Anchors with their contexts: ``anchor, context, doc_key, tie, place``, and ``repeated`` for contexts met earlier in the part."""
        width, match, reach = self.options.anchor, self.options.match, self.options.reach
        data = np.frombuffer(b"".join(piece[1] for piece in part.pieces), np.uint8)
        ends = np.cumsum([len(piece[1]) for piece in part.pieces])
        begins = np.r_[0, ends[:-1]]
        sums = self.first.sums(data)
        starts = np.arange(len(data) - width + 1)
        grams = np.maximum(self.first.of(sums, starts, starts + width), 1)
        least = sliding(grams, reach + 1, np.minimum)            # of the window that starts here; 0 where it leaves its piece
        least[(ends[:-1, None] - np.arange(match - 1, 0, -1)).ravel()] = 0
        best = sliding(np.r_[np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)], reach + 1, np.maximum)[:len(grams)]
        at = np.flatnonzero(grams == best)
        piece = np.searchsorted(ends, at, side="right")
        # Windows with the same least hash follow one another and have their anchors in the same order.
        edge = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        stop = np.r_[edge[1:], len(least)]
        edge, stop = edge[least[edge] > 0], stop[least[edge] > 0]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (grams[at[1:]] != grams[at[:-1]]) | (piece[1:] != piece[:-1])
        run = np.cumsum(fresh) - 1
        low = np.maximum(edge[run], at - reach)
        high = np.minimum(stop[run] - 1, at)                     # first and last window of each anchor
        left, right = at - low, at - high
        context = mixed(self.second.of(self.second.sums(data), low, high + match) ^ ((left << 16) + right).astype(np.uint64))
        docs = np.array([entry[0] for entry in part.pieces], dtype=np.int64)
        pos = at - begins[piece] + np.array([entry[2] for entry in part.pieces])[piece]
        found = {"anchor": grams[at].astype(np.int64), "context": context.astype(np.int64), "doc_key": docs[piece, 0], "tie": docs[piece, 1],
                 "place": (pos << 32) + (left << 16) + right}
        return found | {"repeated": repetitions(found, ("anchor", "context"))}


# A place is a position with the first and the last window of an anchor there, as distances before it.
ANCHORS = "anchor long, context long, doc_key long, tie long, place long, repeated boolean"
FIRST_WINDOW = "shiftright(place, 32) - (shiftright(place, 16) & 65535)"
LAST_WINDOW = "shiftright(place, 32) - (place & 65535)"


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_key, tie, text``. The hash that tells documents of one id apart is left out where all ids differ."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    several = not docs.groupBy(doc.alias("doc")).count().where("count > 1 or doc is null").isEmpty()
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(LAST)).alias("doc_key"),
                       (F.xxhash64(text) if several else F.lit(0).cast("long")).alias("tie"), text.alias("text"))


def anchors(rows: DataFrame, options: DedupOptions) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AnchorFinder(options)

        def texts():
            for batch in batches:
                for doc, tie, text in zip(batch.column("doc_key").to_pylist(), batch.column("tie").to_pylist(), batch.column("text")):
                    yield doc, tie, text.as_buffer().to_pybytes()

        for part in parts_of(texts(), options):
            columns = finder(part)
            yield pa.RecordBatch.from_arrays([pa.array(values) for values in columns.values()], list(columns))

    return rows.select("doc_key", "tie", "text").mapInArrow(found, ANCHORS)


def grouped(found: DataFrame, key: str, content: str) -> DataFrame:
    """``group, is_first`` added, rows partitioned by group: is this the earliest place of the same key and content?

    Places already known to be repeated are dealt out one by one, so that they never form a group.
    """
    place = F.struct(*KEY, "place")
    dealt = found.withColumn("group", F.when(F.col("repeated"), F.xxhash64(content, *KEY, "place")).otherwise(F.col(key)))
    same = Window.partitionBy("group", "repeated", content)
    return dealt.repartition("group", "repeated").withColumn("is_first", (place == F.min(place).over(same)) & ~F.col("repeated"))


def judged_contexts(found: DataFrame) -> DataFrame:
    """``doc_key, tie, place, anchor, contexts`` of places whose context is repeated (``contexts`` 0) or whose anchor has several."""
    own = Window.partitionBy("group", "repeated")
    several = F.min("context").over(own) != F.max("context").over(own)
    contexts = F.when(several & F.col("is_first"), F.sum(F.when(F.col("is_first"), 1).otherwise(0)).over(own)).otherwise(0)
    return (grouped(found, "anchor", "context").withColumn("contexts", contexts)
            .where("not is_first or contexts > 0").select(*KEY, "place", "anchor", "contexts"))


# Shards ---------------------------------------------------------------------------------------

SNIPPETS = "anchor long, contexts long, doc_key long, tie long, start long, bytes binary"


def snippets(texts: DataFrame, places: DataFrame, options: DedupOptions) -> DataFrame:
    """The contexts of ``places`` as bytes; ``texts`` is partitioned by document."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, tie, text, wanted in zip(*(batch.column(name) for name in (*KEY, "text", "wanted"))):
                data = text.as_buffer().to_pybytes()
                for entry in wanted.as_py():
                    out.append((entry["anchor"], entry["contexts"], doc.as_py(), tie.as_py(), entry["first"],
                                data[entry["first"]:entry["last"] + options.match]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*out)], [field.split()[0] for field in SNIPPETS.split(", ")])

    wanted = places.groupBy(*KEY).agg(F.collect_list(F.struct(
        F.expr(FIRST_WINDOW).alias("first"), F.expr(LAST_WINDOW).alias("last"), "anchor", "contexts")).alias("wanted"))
    return texts.join(wanted, KEY).select(*KEY, "text", "wanted").mapInArrow(cut, SNIPPETS)


def repeated_windows(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes], match: int) -> np.ndarray:
    """Rows ``piece, first, last`` of window starts whose string has an earlier place among the pieces; ``docs`` has KEY per piece."""
    sizes = np.array([len(piece) for piece in pieces])
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"".join(piece + b"\0" for piece in pieces), np.uint8).astype(np.int16) + 2
    text[begins + sizes] = 1                                   # between pieces
    text = np.r_[text, np.zeros(1, np.int16)]
    array = suffix_array(text, 258)
    shared, _ = common_prefixes(text, array, match)
    valid = np.zeros(len(text), bool)
    counts = sizes - match + 1
    windows = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    valid[windows] = True
    owner = np.zeros(len(text), np.int64)
    owner[windows] = np.repeat(np.arange(len(pieces)), counts)
    # Documents by their order, then the place in the document: one number per window.
    _, ordinal = np.unique(docs, axis=0, return_inverse=True)
    place = np.zeros(len(text), np.int64)
    place[windows] = (ordinal.reshape(-1)[owner[windows]] << 40) + starts[owner[windows]] + windows - begins[owner[windows]]
    joined = shared[array] >= match
    array, joined = array[valid[array]], joined[valid[array]]
    heads = np.flatnonzero(~joined)
    if not len(heads):
        return np.zeros((0, 3), np.int64)
    earliest = np.minimum.reduceat(place[array], heads)
    late = np.zeros(len(text) + 1, bool)
    late[array] = place[array] > np.repeat(earliest, np.diff(np.r_[heads, len(array)]))
    edges = np.flatnonzero(late[1:] != late[:-1]) + 1          # window 0 belongs to a run if late[0]
    if late[0]:
        edges = np.r_[0, edges]
    first, last = edges[::2], edges[1::2] - 1
    return np.stack([owner[first], first - begins[owner[first]], last - begins[owner[first]]], axis=1)


STRETCHES = "doc_key long, tie long, start long, stop long"


def shard_stretches(rows: DataFrame, options: DedupOptions) -> DataFrame:
    """Repeated stretches of the snippets, shard by shard; an anchor lies in one shard."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("anchor", *KEY, "start", "bytes"))):
                if row[0] != last and size >= options.shard_bytes:
                    yield held
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[-1])
        if held:
            yield held

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            docs, starts = np.array([row[1:3] for row in shard], np.int64), np.array([row[3] for row in shard], np.int64)
            found = repeated_windows(docs, starts, [row[4] for row in shard], options.match)
            owner = found[:, 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[owner, 0]), pa.array(docs[owner, 1]), pa.array(starts[owner] + found[:, 1]),
                 pa.array(starts[owner] + found[:, 2] + options.match)], ["doc_key", "tie", "start", "stop"])

    ordered = rows.where(F.col("contexts") <= options.hot_contexts).repartition("anchor").sortWithinPartitions("anchor")
    return ordered.select("anchor", *KEY, "start", "bytes").mapInArrow(stretches, STRETCHES)


def hot_stretches(rows: DataFrame, options: DedupOptions) -> DataFrame:
    """The same for anchors with too many contexts for a shard: window by window, by two hashes of 64 bits."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Hashes(13), Hashes(14)
        for batch in batches:
            pieces = batch.column("bytes").to_pylist()
            if not pieces:
                continue
            data = np.frombuffer(b"".join(pieces), np.uint8)
            sizes = np.array([len(piece) for piece in pieces])
            counts = sizes - options.match + 1
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
            found = {name: hashes.of(hashes.sums(data), starts, starts + options.match).astype(np.int64)
                     for name, hashes in (("one", first), ("two", second))}
            found |= {name: np.repeat(batch.column(name).to_numpy(), counts) for name in KEY}
            found["place"] = np.repeat(batch.column("start").to_numpy(), counts) + offset
            found["repeated"] = repetitions(found, ("one", "two"))
            yield pa.RecordBatch.from_arrays([pa.array(values) for values in found.values()], list(found))

    hot = rows.where(F.col("contexts") > options.hot_contexts).select(*KEY, "start", "bytes")
    found = hot.mapInArrow(windows, "one long, two long, doc_key long, tie long, place long, repeated boolean")
    return grouped(found, "one", "two").where("not is_first").select(
        *KEY, F.col("place").alias("start"), (F.col("place") + options.match).alias("stop"))


# Documents ------------------------------------------------------------------------------------


def stretches(spark: SparkSession, docs: DataFrame, options: DedupOptions = DedupOptions()) -> tuple[DataFrame, DataFrame]:
    """The keyed texts, partitioned by document, and the repeated stretches ``doc_key, tie, start, stop`` (they overlap)."""
    rows = keyed(docs)
    judged = written(spark, judged_contexts(anchors(rows, options)), "contexts")
    texts = rows.repartition(*KEY)
    cut = written(spark, snippets(texts, judged.where("contexts > 0"), options), "snippets")
    whole = judged.where("contexts = 0").selectExpr(*KEY, f"{FIRST_WINDOW} as start", f"{LAST_WINDOW} + {options.match} as stop")
    return texts, whole.unionByName(shard_stretches(cut, options)).unionByName(hot_stretches(cut, options))


def merged(owner: np.ndarray, starts: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching stretches of the same text as one: owners, starts, stops in order."""
    shift = np.cumsum(sizes + 1) - sizes - 1                    # all texts on one line, with a gap between them
    order = np.argsort(starts + shift[owner], kind="stable")
    owner, starts, stops = owner[order], starts[order], stops[order]
    reached = np.maximum.accumulate(stops + shift[owner])
    heads = np.ones(len(order), bool)
    heads[1:] = starts[1:] + shift[owner[1:]] > reached[:-1]
    first = np.flatnonzero(heads)
    last = np.r_[first[1:], len(order)] - 1
    return owner[first], starts[first], reached[last] - shift[owner[first]]


def deduplicated(spark: SparkSession, docs: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: per document the removed spans (bytes from, to) and the remaining bytes."""
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [text.as_buffer().to_pybytes() for text in batch.column("text")]
            sizes = np.array([len(text) for text in texts])
            marks = batch.column("marks")
            listed, counts = marks.flatten(), np.diff(np.r_[0, np.cumsum([len(entry) if entry.is_valid else 0 for entry in marks])])
            owner, starts, stops = merged(np.repeat(np.arange(len(texts)), counts), *(listed.field(name).to_numpy() for name in ("start", "stop")), sizes)
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            kept = []
            for text, low, high in zip(texts, offsets[:-1], offsets[1:]):
                ends = [0, *stops[low:high].tolist()]
                kept.append(b"".join(text[end:start] for end, start in zip(ends, [*starts[low:high].tolist(), len(text)])))
            spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(stops)], ["start", "stop"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), spans),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    texts, found = stretches(spark, docs, options)
    marks = found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    return texts.join(marks, KEY, "left").select("doc_id", "text", "marks").mapInArrow(
        removed, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(spark, documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["stop"] - span["start"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))
