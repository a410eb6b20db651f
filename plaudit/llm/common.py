"""What the operators share: table access, folds, batches of bounded size."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.sources.staging import written

__all__ = ["chunks", "crc_fold", "documents", "fresh_name", "labels", "sample_of", "ids_crc32", "one_per_id", "texts_of", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc_fold(column: str | Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo ``folds``; null ids have none."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % F.lit(folds)


def fresh_name(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that the rows do not have yet."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample_of(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows (all, if there are no more), chosen by a hash of ``key`` alone."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(bound / total * (1 << 30))))


def one_per_id(rows: DataFrame, names: list[str]) -> DataFrame:
    """``doc_id`` and the named columns of one row of each id, that of the least ``tie``, so that copies of an id weigh once.

    Rows are reduced before they are shuffled.
    """
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*names), "tie").alias("row")).select("doc_id", "row.*")


def chunks(texts: list[str], max_chars: int) -> Iterator[slice]:
    """Slices of a batch that hold about ``max_chars`` characters each; a longer text stands alone."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        if at > start and held + len(text) > max_chars:
            yield slice(start, at)
            start, held = at, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def texts_of(values: Iterable) -> list[str]:
    """Null texts as empty ones."""
    return [value if isinstance(value, str) else "" for value in values]


def ids_crc32(ids) -> int:
    """Unsigned crc32 of token ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
