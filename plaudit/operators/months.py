"""Month sets: distinct months, the most recent ones, and rows that fall into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def distinct_months(rows: DataFrame) -> DataFrame:
    return rows.select("month").distinct()


def recent_months(rows: DataFrame, count: int) -> DataFrame:
    """The last ``count`` months in text order, or fewer when there are not as many."""
    return distinct_months(rows).orderBy(F.desc("month")).limit(count)


def in_recent_months(rows: DataFrame, count: int, of: DataFrame | None = None) -> DataFrame:
    """Rows of the most recent months: the ones from the earliest of these months on.

    A comparison with a scalar subquery instead of a join, so it is a plain filter at the scan and
    prunes the folders of a table staged by month.
    """
    start = recent_months(rows if of is None else of, count).agg(F.min("month")).scalar()
    return rows.filter(F.col("month") >= start)
