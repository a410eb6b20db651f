"""Reviews as Parquet by month: the CSV is parsed once, later queries prune and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plaudit.config import EXPORT_COLUMNS
from plaudit.functions.dates import month_key
from plaudit.functions.ratings import has_text, na_to_null
from plaudit.session import scratch_path

STAGED = T.StructType(
    [T.StructField(name, T.StringType()) for _, name in EXPORT_COLUMNS]
    + [T.StructField("has_text", T.BooleanType()), T.StructField("known_text", T.BooleanType()),
       T.StructField("month", T.StringType())])


def write_staged(raw: DataFrame, path: str, mode: str = "error") -> None:
    """Raw rows in one folder per month. ``rebalance`` splits big months over tasks and joins small ones.

    Values stay as they were, so both dialects can read them. The flags tell whether there is a
    text (``has_text`` in the strict dialect, ``known_text`` in the tolerant one): filters and
    counts then leave the text column unread.
    """
    flagged = raw.withColumns({"has_text": has_text(F.col("review")), "known_text": has_text(na_to_null("review")),
                               "month": month_key(F.col("published"))})
    (flagged.select(*STAGED.fieldNames()).hint("rebalance", "month")
     .write.mode(mode).partitionBy("month").parquet(path))


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """The schema is given, so that a month stays text and is not taken for a date."""
    return spark.read.schema(STAGED).parquet(path)


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def written_buckets(spark: SparkSession, frame: DataFrame, name: str, key: str) -> DataFrame:
    """The frame as a table in the shared folder, hashed into buckets by ``key`` and sorted in each.

    Joins on the key need no shuffle of it. Buckets are as many as shuffle partitions, so that a frame that is
    partitioned by the key already is written as it lies.
    """
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
