"""Batches of a fixed size in a stated order, at any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.ratings import rated_side
from plaudit.functions.text import prefix
from plaudit.operators.months import in_recent_months
from plaudit.operators.ordinals import running_position
from plaudit.sources.exports import placed


def bucket_reviews(rated_text: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(sentiment, month, review_id, review)`` of the most recent months, review cut for prompts.

    Rows that were read with their positions keep them.
    """
    recent = in_recent_months(rated_text, settings.recent_months)
    return recent.select(
        rated_side(F.col("rating"), settings).alias("sentiment"), "month", "review_id",
        prefix(F.col("review"), settings.prompt_chars).alias("review"), *placed(rated_text))


def bucket_counts(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("sentiment", "month").agg(F.count("*").alias("n"))


def row_hash(columns: list[str]) -> Column:
    """MD5 of a row, null values as empty ones."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(name).cast("string"), F.lit("")) for name in columns)))


def row_key(columns: list[str]) -> Column:
    """``row_hash`` with what it does not tell: which values are null, and where a column ends."""
    nulls = (F.when(F.col(name).isNull(), "0").otherwise("1") for name in columns)
    return F.concat(row_hash(columns), *nulls, F.hex(F.xxhash64(*columns)))


SPAN_ROWS = 100_000


def span_digits(rows: DataFrame, span_rows: int = SPAN_ROWS) -> Column:
    """Digits of a hash that cut ``rows`` into spans of at most about ``span_rows``: a scalar, 4 at least."""
    count = rows.agg(F.count("*")).scalar()
    return F.greatest(F.lit(4), F.ceil(F.log(16.0, F.greatest(count / span_rows, F.lit(1.0))))).cast("int")


def assign_batches(rows: DataFrame, keys: list[str], levels: list[str], size: int,
                   hash_digits: int | None = None) -> DataFrame:
    """Add ``row_no`` and ``batch_no`` (from 1) and ``total_batches`` within ``keys`` (none: all rows).

    Order: ``levels``, then the MD5 of the whole row. The first digits of it cut every group into spans of about the same
    size, also where ids are missing or repeated; as many digits as the number of rows asks for, or ``hash_digits``, with
    the same result. All batches but the last of a group are full. Equal rows are counted before the shuffle and laid out
    again batch by batch, so that a review copied any number of times never forms one large span.

    Positions are computed on hashes and numbers of copies alone. The other columns travel twice: to meet the
    position of their hash, one of equal rows from each task, and to their batch. The result is hash-partitioned by
    ``batch_no`` (keys may be constants, which Spark leaves out of groups); grouping by keys and ``batch_no`` needs no shuffle.
    """
    columns = rows.columns
    hashed = rows.withColumn("row_key", row_key(columns))
    digits = F.lit(hash_digits) if hash_digits else span_digits(rows)
    slim = (hashed.groupBy(*keys, *levels, "row_key").agg(F.count("*").alias("copies"))
            .withColumn("spread", F.left("row_key", digits)))
    placed = running_position(slim, keys, [*levels, "spread"], ["row_key"], "last_row", weight="copies")
    texts = hashed.groupBy("row_key").agg(F.first(F.struct(*columns)).alias("row"))
    found = texts.join(placed.select("row_key", "last_row", "copies", "group_rows"), "row_key").select(
        "row.*", "last_row", "copies", "group_rows")

    first, last = F.col("last_row") - F.col("copies"), F.col("last_row") - 1  # from 0
    batches = F.sequence(F.floor(first / size), F.floor(last / size))
    per_batch = found.select(
        *columns, "last_row", "copies",
        F.ceil(F.col("group_rows") / size).alias("total_batches"),
        F.explode(batches).alias("batch"))
    start = F.greatest(first, F.col("batch") * size)
    end = F.least(last, (F.col("batch") + 1) * size - 1)
    return (per_batch.withColumn("batch_no", F.col("batch") + 1)
            .repartition("batch_no")
            .select(*columns, "batch_no", "total_batches",
                    F.explode(F.sequence(start + 1, end + 1)).alias("row_no")))


def assign_batches_in_order(rows: DataFrame, keys: list[str], levels: list[str], size: int, position: list[str]) -> DataFrame:
    """``assign_batches`` in the order of the export: ``levels``, then ``position`` (file, range, line), which is dropped.

    A range of a file is a span: its rows are counted, the counts of earlier ranges make its start. As above, positions are
    computed without the other columns, which travel twice.
    """
    columns = [name for name in rows.columns if name not in position]
    placed_rows = running_position(rows.select(*keys, *levels, *position), keys, [*levels, *position[:-1]], position[-1:], "row_no")
    numbered = placed_rows.select(*position, "row_no", F.ceil(F.col("group_rows") / size).alias("total_batches"))
    return (rows.join(numbered, position).select(*columns, "total_batches", "row_no")
            .withColumn("batch_no", F.floor((F.col("row_no") - 1) / size) + 1).repartition("batch_no"))


def sentiment_batches(buckets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Categorisation batches: per sentiment, month by month; in the export's order if the rows have their positions."""
    position = placed(buckets)
    if position:
        return assign_batches_in_order(buckets, ["sentiment"], ["month"], settings.batch_size, position)
    return assign_batches(buckets, ["sentiment"], ["month"], settings.batch_size)
