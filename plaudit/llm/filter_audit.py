"""Filter interaction audit: what each filter removes in every order of five filters.

Documents become rows of a few bytes (part, id, failed filters, labels). Ranges of ids, cut by Spark's range partitioning
and by the batches within a task, are the blocks: for each filter a block of a part has the sorted posting list of its
failing documents. Unions of lists come from k-way merges and differences from searches of whole runs (each list is
galloped through with the shorter one), one union per set of filters, one difference per set and next filter; only sizes
leave a block, and sizes add up over blocks. 120 orders of five steps have 80 different (set before, filter) pairs.

Defined cases: null text is the empty text, which fails A alone (no word is not under half of no words) and E if a smaller id
is empty too. Null language is the part ``''``. A null id is neither smaller nor larger than another: such rows never fail E.
Repeated rows count as often as they occur; rows of one id do not make each other duplicates. A document is good (toxic) if
any label row of its id says so. No documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaudit.llm.common import documents, labels, texts_of, written
from plaudit.operators.joins import lookup_join

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = re.compile(r"[#$%&*|]")
JUDGED = "doc_id long, part string, fails int, key binary"
SIZES = ("docs", "kept", "removed", "redundant", "good_lost", "toxic_lost")


def failures(text: str, data: bytes) -> int:
    """Bits of the failed filters A to D; ``bytes.split`` cuts at exactly the six ASCII blanks."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, UPPER))
    failed = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text),
              SYMBOLS.search(text) is not None)
    return sum(bit << at for at, bit in enumerate(failed))


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, fails, key``: failed filters A to D and the MD5 of the text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, keys = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                data = text.encode()
                fails.append(failures(text, data))
                keys.append(hashlib.md5(data).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(fails, pa.int32()), pa.array(keys, pa.binary())],
                ["doc_id", "part", "fails", "key"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return slim.mapInArrow(rows, JUDGED)


def with_copies(rows: DataFrame) -> DataFrame:
    """Filter E added to ``fails``, equal rows as one with their number ``n``.

    Of each text the least id passes. It is sent to its own row by a second grouping instead of a join, so that a
    text copied over a third of all rows is never in one place.
    """
    packed = rows.groupBy("key", "doc_id", "part").agg(F.first("fails").alias("fails"), F.count("*").alias("n"))
    least = packed.groupBy("key").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    entry = F.struct("part", "fails", "n")
    both = packed.select("key", "doc_id", entry.alias("row"), F.lit(False).alias("least")).unionByName(
        least.select("key", "doc_id", F.lit(None).cast("struct<part:string,fails:int,n:bigint>").alias("row"), F.lit(True).alias("least")))
    merged = both.groupBy("key", "doc_id").agg(F.max("least").alias("least"), F.collect_list("row").alias("rows"))  # a row per part
    copy = F.when(F.col("least") | F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(1 << FILTERS.index("E")))
    return merged.select("key", "doc_id", copy.alias("copy"), F.inline("rows")).select(
        "key", "doc_id", "part", F.col("fails").bitwiseOR(F.col("copy")).alias("fails"), "n")


def with_labels(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``good`` and ``toxic`` added; hot and missing ids are spread by the join."""
    known = marks.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = known.where("good or toxic")
    return lookup_join(rows, marked, "doc_id", ["key"]).withColumns(
        {name: F.coalesce(name, F.lit(False)) for name in ("good", "toxic")}).drop("matched")


def searched(needles: np.ndarray, stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the needles in the stack (both sorted), and which of them are there."""
    at = np.searchsorted(stack, needles)
    there = np.zeros(len(needles), bool)
    inside = at < len(stack)
    there[inside] = stack[at[inside]] == needles[inside]
    return at, there


def difference(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The ids that are not among the others; the shorter list gallops through the longer one."""
    if len(ids) <= len(others):
        return ids[~searched(ids, others)[1]]
    at, there = searched(others, ids)
    return np.delete(ids, at[there])


def union(lists: list[np.ndarray]) -> np.ndarray:
    """K-way merge: the shorter lists gallop through the merged longer ones."""
    merged, *rest = sorted(lists, key=len, reverse=True)
    for ids in rest:
        at, there = searched(ids, merged)
        merged = np.insert(merged, at[~there], ids[~there])
    return merged


def block_sizes(fails: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sizes ``[filter, set of earlier filters, SIZES]`` of a block; ``n`` is the number of documents a row stands for."""
    lists = [np.flatnonzero(fails >> at & 1) for at in range(len(FILTERS))]
    none = np.zeros(0, np.int64)
    unions = [union([lists[at] for at in range(len(FILTERS)) if done >> at & 1] or [none]) for done in range(EVERY + 1)]
    docs, sizes = n.sum(), np.zeros((len(FILTERS), EVERY + 1, len(SIZES)), np.int64)
    for at, own in enumerate(lists):
        failing = n[own].sum()
        for done in range(EVERY + 1):
            if not done >> at & 1:
                lost = difference(own, unions[done])
                removed = n[lost].sum()
                sizes[at, done] = (docs, docs - n[unions[done | 1 << at]].sum(), removed, failing - removed,
                                   n[lost][good[lost]].sum(), n[lost][toxic[lost]].sum())
    return sizes


def blocks(rows: DataFrame) -> DataFrame:
    """``part, filter, done, SIZES``: a row per part, filter and set of earlier filters for each range of ids."""
    def audited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = None, None
        for frame in frames:
            for name, own in frame.groupby("part", sort=True):
                if part != name:
                    if total is not None:
                        yield listed(part, total)
                    part, total = name, 0
                total = total + block_sizes(*(own[column].to_numpy() for column in ("fails", "good", "toxic", "n")))
        if total is not None:
            yield listed(part, total)

    def listed(part: str, total: np.ndarray) -> pd.DataFrame:
        at, done = np.array([(at, done) for at in range(len(FILTERS)) for done in range(EVERY + 1) if not done >> at & 1]).T
        return pd.DataFrame({"part": part, "filter": at, "done": done, **{name: total[at, done, k] for k, name in enumerate(SIZES)}})

    ranges = rows.repartitionByRange("part", "doc_id", "key").sortWithinPartitions("part", "doc_id", "key")
    return ranges.select("part", "fails", "good", "toxic", "n").mapInPandas(
        audited, "part string, filter int, done int, " + ", ".join(f"{name} long" for name in SIZES))


def filter_interactions(spark: SparkSession, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Sizes of every part, order of the filters and step, see the module."""
    rows = with_labels(with_copies(written(spark, judged(docs), "judged")), marks)
    sums = blocks(rows).groupBy("part", "filter", "done").agg(*(F.sum(name).alias(name) for name in SIZES))
    # An order with the filter behind exactly the set `done` occurs |done|! (4 - |done|)! times.
    times = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))),
                         F.bit_count("done") + 1)
    own = Window.partitionBy("part", "filter")
    last = F.expr(f"done + shiftleft(1, filter) = {EVERY}")
    rated = sums.withColumns({"shapley": F.sum(F.col("removed") * times).over(own),
                              "unique_fails": F.max(F.when(last, F.col("removed"))).over(own)})
    steps = [("".join(order), step + 1, FILTERS.index(order[step]), sum(1 << FILTERS.index(name) for name in order[:step]))
             for order in permutations(FILTERS) for step in range(len(FILTERS))]
    table = spark.createDataFrame(steps, "filter_order string, step int, filter int, done int")  # 600 rows, always
    return rated.join(F.broadcast(table), ["filter", "done"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(spark, documents(spark, sf_dir), labels(spark, sf_dir))
