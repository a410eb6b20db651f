"""CSV with quoted line breaks, read by many tasks per file.

Whether a line break ends a record depends on all quotes before it, so a byte range cannot tell where its first record
begins. It need not read on from the start of the file, though: only the parity of the quotes counts (a doubled quote
inside a field changes nothing). Two passes over the lines, which Spark splits by byte ranges:

1. Quotes are counted per range; running sums over the ranges of a file give the parity at each range's start.
2. Each task joins the lines of its ranges to records, which end where the parity is even. The lines before the first end, and those
   after the last one, are fragments of records that cross ranges: two per range at most, put together by file and order.

Lines end in ``\\n`` or ``\\r\\n``; breaks inside quotes stay as they are. A quote inside an unquoted field counts as well, as
such files cannot be split. Files of other quoting rules need ``multiLine``, one task per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaudit.sources.staging import written

RANGE = ["file", "range"]
POSITION = ["file", "range", "line"]        # where a record begins; their order is that of the export
RECORDS = "file string, range long, line long, text string, first boolean, fragment boolean, begins boolean"
BROADCAST_RANGES = 100_000                  # ranges that begin inside quotes: a path and a number each


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))


def inside_quotes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, range`` of the byte ranges that begin inside quotes; written, a row per range at most."""
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    counted = _lines(spark, paths).groupBy(*RANGE).agg(quotes.alias("quotes"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    odd = counted.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0))).filter("before % 2 = 1")
    return written(spark, odd.select(*RANGE), "ranges")


def records(spark: SparkSession, paths: str | list[str], broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """``file, range, line, text, first`` of all records, blank lines left out; ``first`` marks the header of a file."""
    inside, lines = inside_quotes(spark, paths), _lines(spark, paths)
    odd = inside.withColumn("inside", F.lit(True))
    count = inside.count()
    if count == 0:
        ranged = lines.withColumn("inside", F.lit(False))
    elif count <= broadcast_ranges:
        ranged = lines.join(F.broadcast(odd), RANGE, "left")                # keeps the order of the lines
    else:
        numbered = lines.withColumn("number", F.monotonically_increasing_id())
        ranged = numbered.join(odd, RANGE, "left").repartition(*RANGE).sortWithinPartitions(*RANGE, "number")
    found = ranged.select("file", "range", "value", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(_joined, RECORDS)
    kept = written(spark, found, "records")
    whole = kept.filter("not fragment").select(*POSITION, "text", "first")
    order = Window.partitionBy("file").orderBy("range", "begins")
    parts = kept.filter("fragment").withColumn("nth", F.sum(F.col("begins").cast("int")).over(order))
    piece = F.struct("range", "begins", "line", "text", "first")
    put = parts.groupBy("file", "nth").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    head = F.get("pieces", F.lit(0))
    text = F.array_join(F.transform("pieces", lambda row: row["text"]), "\n")
    crossing = put.select("file", head["range"].alias("range"), head["line"].alias("line"), text.alias("text"), head["first"].alias("first"))
    return whole.unionByName(crossing).withColumn("text", F.regexp_replace("text", "\r$", ""))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to records and fragments, see ``RECORDS``; a task has whole ranges, line after line."""
    names = [field.split()[0] for field in RECORDS.split(", ")]
    here, held, out = None, [], []
    number = start = 0                      # of the next line and of the held record's first line
    odd = begun = header = False            # parity, whether the held record begins here, whether the file's first record is to come

    def closed(fragment: bool) -> None:
        nonlocal held, header
        text = "\n".join(held)
        if fragment or text not in ("", "\r"):
            out.append((*here, start, text, begun and header, fragment, begun))
            header = header and not begun
        held = []

    for batch in batches:
        for file, place, value, inside in zip(*(column.to_pylist() for column in batch.columns)):
            if (file, place) != here:
                if held:
                    closed(True)
                here, number, odd, header = (file, place), 0, inside, place == 0
            if not held:
                start, begun = number, not odd
            held.append(value)
            number += 1
            odd ^= value.count('"') & 1 == 1
            if not odd:
                closed(not begun)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*out)], names)
            out.clear()
    if held:
        closed(True)
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*out)], names)


def read_split_csv(spark: SparkSession, paths: str | list[str], header: list[str], options: dict[str, str],
                   broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """The columns of ``header`` (as the first file has them) and ``POSITION``, all values as text.

    Another header in any of the files is an error.
    """
    found = records(spark, paths, broadcast_ranges)
    fields = [f"c{at}" for at in range(len(header))]
    row = F.from_csv("text", F.lit(", ".join(f"{name} string" for name in fields)), {**options, "multiLine": "true"})
    parsed = found.withColumn("row", row)
    same = F.concat_ws("\x1f", *(F.coalesce(F.col(f"row.{name}"), F.lit("")) for name in fields)) == "\x1f".join(header)
    other = F.raise_error(F.concat(F.lit("unexpected CSV header in "), "file", F.lit(": "), "text"))
    data = parsed.filter(~F.when(F.col("first"), F.when(same, True).otherwise(other.cast("boolean"))).otherwise(False))
    return data.select(*POSITION, *(F.col(f"row.{name}").alias(title) for name, title in zip(fields, header)))
