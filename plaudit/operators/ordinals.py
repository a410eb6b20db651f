"""Row positions within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.sources.staging import written


def running_position(rows: DataFrame, keys: list[str], spans: list[str], order: list[str | Column],
                     out: str, weight: str | None = None) -> DataFrame:
    """Add ``out``: the running count of rows within ``keys``, ordered by ``spans`` then ``order``.

    A group may hold a third of all rows, so it is cut into ``spans``: columns of bounded group
    size that follow the wanted order. The spans are counted with a partial aggregate, their starts
    come from a window over these few counts, and the window over the rows works span by span.
    ``weight`` names a column with the number of copies a row stands for. ``group_rows`` is added
    as well: the size of the whole group. Keys and spans must not be null.
    """
    cut = [*keys, *spans]
    amount = F.col(weight) if weight else F.lit(1)
    sizes = rows.groupBy(*cut).agg(F.sum(amount).alias("span_rows"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(*spans).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *cut,
        F.coalesce(F.sum("span_rows").over(before), F.lit(0)).alias("span_start"),
        F.sum("span_rows").over(group).alias("group_rows"),
    )
    within = (Window.partitionBy(*cut).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("span_position", F.sum(amount).over(within))
    return (placed.join(starts, cut)
            .withColumn(out, F.col("span_start") + F.col("span_position"))
            .drop("span_start", "span_position"))


def position_in_order(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the place of each row (from 1) in ``order``, which must tell rows apart.

    For orders that have no columns to cut spans by: the rows are written in ranges of the order, the ranges
    are counted, and each is numbered by itself.
    """
    ranged = rows.repartitionByRange(*order).withColumn("span", F.spark_partition_id())
    stored = written(rows.sparkSession, ranged, "ranges")
    return running_position(stored, [], ["span"], order, out).drop("span", "group_rows")
