"""Tables behind the charts, labels included."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.dates import month_label, month_label_short
from plaudit.functions.numbers import decimals, round_exact
from plaudit.functions.text import wrap_label
from plaudit.operators.categories import month_pairs
from plaudit.operators.metrics import monthly_metrics, rating_cube, rolled_mean, rolled_up
from plaudit.operators.months import in_recent_months


def chart_monthly(rated: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Stacked volume and average per month."""
    return monthly_metrics(rated, settings).select(
        "month", month_label(F.col("month")).alias("label"), "pos", "neg", "avg_rating",
        decimals("avg_rating", 2).alias("avg_label"))


def chart_two_sources(rated: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Volume and average of the compared sources side by side, one row per recent month.

    Months are matched by name: a source without reviews in a month has volume 0 and no average.
    Months count over all sources, so the columns come from one conditional aggregation.
    """
    counts, shown = [], []
    for name, source in settings.compared_sources:
        own = F.col("source") == source
        counts += [rolled_up("vol", own).alias(f"{name}_vol"), rolled_mean(own).alias(f"{name}_mean")]
        shown += [F.col(f"{name}_vol"), round_exact(f"{name}_mean", 2).alias(f"{name}_rating")]
    counted = in_recent_months(rating_cube(rated, settings), settings.recent_months, of=rated).groupBy("month").agg(*counts)
    return counted.select("month", month_label(F.col("month")).alias("label"), *shown)


def chart_categories(counts: DataFrame, sentiment: str) -> DataFrame:
    """Reviews per category in the first two months of a sentiment, 0 where there are none."""
    pairs = month_pairs(counts.filter(F.col("sentiment") == sentiment))
    return pairs.select(
        "category", wrap_label(F.col("category")).alias("label"),
        month_label_short(F.col("month_1")).alias("month_1"), "n_1",
        month_label_short(F.col("month_2")).alias("month_2"), "n_2")
