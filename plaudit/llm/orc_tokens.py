"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on the document ids.

Documents are dealt to files by ranges of their ids and sorted within, so each stripe covers a narrow
range of ids: readers take stripes in parallel and skip by minimum and maximum, then by Bloom filter. Global
starts are the totals of the files before plus the running sum within the file.

Cases: a null text counts as empty and holds the end id alone; null document ids come first; repeated ids
stand side by side, in the order of a hash of their texts; an empty table gives an empty folder of files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaudit.llm.common import chunks, documents, ids_crc32, texts_of, written
from plaudit.llm.library_tokens import word_memory
from plaudit.llm.segments import PART_CHARS
from plaudit.session import scratch_path

SCHEMA = "doc_id long, tie long, ids array<int>"


@dataclass(frozen=True)
class OrcOptions:
    end_id: int = 2
    stripe_bytes: int = 64 << 20
    index_rows: int = 1_000
    bloom_rate: float = 0.01
    compression: str = "zstd"


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, tie, ids`` in the order of the input."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory(path)
        for batch in batches:
            texts = texts_of(batch.column("text").to_pylist())
            for part in chunks(texts, PART_CHARS):
                ids, counts = memory.ids(texts[part])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                offsets = np.r_[0, ends + np.arange(1, len(ends) + 1)].astype(np.int32)
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("tie"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                    ["doc_id", "tie", "ids"])

    return docs.mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, options: OrcOptions = OrcOptions()) -> None:
    """One file per range of document ids. Only texts are shuffled; ids are made where they are written."""
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    ordered = placed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie")
    (encoded(ordered, tokenizer, options.end_id).write
     .option("compression", options.compression).option("orc.stripe.size", options.stripe_bytes)
     .option("orc.row.index.stride", options.index_rows).option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", options.bloom_rate).orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents in the files."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            crcs = [ids_crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), batch.column("file"), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "tie", "file", "n_tokens", "ids_crc32"])

    rows = written(spark, read_tokens(spark, path).withColumn("file", F.input_file_name())
                   .mapInArrow(digest, "doc_id long, tie long, file string, n_tokens long, ids_crc32 long"), "digests")
    # One row per file: ranges of ids do not overlap.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("least"))
    earlier = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
            .select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = scratch_path(spark, "orc-tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return digests(spark, path)
