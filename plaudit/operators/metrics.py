"""Rating metrics: each is one pass of partial and final aggregation.

``reviews`` below are coerced rows with every review; ``rated`` are ``(month, rating, source)`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.dates import review_timestamp
from plaudit.functions.numbers import exact, fraction, percent, round_exact
from plaudit.functions.ratings import is_excluded, is_positive, three_way
from plaudit.operators.months import in_recent_months
from plaudit.sources.exports import is_analysable


def review_cube(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One small row per source (a missing one included): everything the report tells about the whole export.

    Totals, platforms and the number of negative reviews roll up from it, so a report that writes it reads the reviews once.
    """
    rating = exact(F.col("rating"))
    side, dated = three_way(F.col("rating"), settings), review_timestamp(F.col("published"))
    return reviews.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(is_analysable(reviews, settings)).alias("analysed"),
        F.count(rating).alias("given"), F.sum(rating).alias("stars"),
        F.count_if(side == "pos").alias("pos"), F.count_if(side == "neg").alias("neg"),
        F.min(dated).alias("first_ts"), F.max(dated).alias("last_ts"))


def cube_stats(cube: DataFrame) -> DataFrame:
    """``export_stats`` of the cube."""
    return cube.agg(
        rolled_up("total").alias("total"), rolled_up("analysed").alias("analysed"),
        F.try_divide(F.sum("stars").cast("double"), F.sum("given")).alias("avg_rating"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def cube_platforms(cube: DataFrame) -> DataFrame:
    """``platform_stats`` of the cube."""
    mean = cube.filter(F.col("source").isNotNull()).withColumn("mean", F.try_divide(F.col("stars").cast("double"), F.col("given")))
    return mean.select(
        "source", "total", round_exact("mean", 1).alias("avg_rating"),
        "pos", percent("pos", "total").alias("pos_pct"),
        "neg", percent("neg", "total").alias("neg_pct"),
    )


def cube_negatives(cube: DataFrame) -> DataFrame:
    """``negative_total`` of the cube."""
    return cube.agg(rolled_up("neg").alias("total_neg"))


def export_stats(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: number of reviews and of analysable ones, mean rating, first and last date."""
    return cube_stats(review_cube(reviews, settings))


def platform_stats(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per source, unrated reviews included in the total; a missing source has no row."""
    return cube_platforms(review_cube(reviews, settings))


def negative_total(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row with the number of reviews rated up to the three-way limit."""
    return cube_negatives(review_cube(reviews, settings))


def rating_cube(rated: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(month, source, vol, given, total, pos, neg)``: one small row per month and source.

    All metrics by month or source roll up from it. ``total`` is the exact sum of ``given`` ratings; queries that
    use the cube several times share its one pass over the reviews.
    """
    rating = exact(F.col("rating"))
    positive = is_positive(F.col("rating"), settings)
    return rated.groupBy("month", "source").agg(
        F.count("*").alias("vol"), F.count(rating).alias("given"), F.sum(rating).alias("total"),
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def rolled_up(name: str, kept: Column | None = None) -> Column:
    """Sum of a column of the cube over its ``kept`` rows, 0 where there are none."""
    value = F.col(name) if kept is None else F.when(kept, F.col(name))
    return F.coalesce(F.sum(value), F.lit(0))


def rolled_mean(kept: Column | None = None) -> Column:
    """Mean rating over the ``kept`` rows of the cube, null where there are none."""
    return F.try_divide(rolled_up("total", kept).cast("double"), rolled_up("given", kept))


def latest_sentiment(rated: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Two rows, ``pos`` and ``neg``, for the latest month of all sources; excluded ones not counted."""
    cube = rating_cube(rated, settings)
    latest = cube.agg(F.max("month")).scalar()
    kept = cube.filter((F.col("month") == latest) & ~is_excluded(F.col("source"), settings))
    counted = kept.agg(*(rolled_up(name).alias(new) for name, new in (("vol", "total"), ("pos", "pos"), ("neg", "neg"))))
    sides = F.array(*[F.struct(F.lit(side).alias("sentiment"), F.col(side).alias("vol"))
                      for side in ("pos", "neg")])
    return (counted.select("total", F.inline(sides))
            .select("sentiment", fraction("vol", "total").alias("pct"), "vol"))


def monthly_metrics(rated: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Average, positives and negatives per month. A month with excluded sources only stays, with null."""
    kept = ~is_excluded(F.col("source"), settings)
    counted = rating_cube(rated, settings).groupBy("month").agg(
        rolled_mean(kept).alias("mean"), rolled_up("pos", kept).alias("pos"), rolled_up("neg", kept).alias("neg"))
    return counted.select("month", round_exact("mean", 2).alias("avg_rating"), "pos", "neg")


def source_breakdown(rated: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Average and volume per source in the most recent months, no source excluded."""
    recent = in_recent_months(rating_cube(rated, settings), settings.recent_months, of=rated)
    mean = recent.withColumn("mean", F.try_divide(F.col("total").cast("double"), F.col("given")))
    return mean.select("source", "month", round_exact("mean", 2).alias("avg_rating"), "vol")


def without_sources(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Anti join for a list of sources kept as a table; rows without a source stay."""
    return rows.join(excluded.select("source").distinct(), "source", "left_anti")


def metrics_document(rated: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(part, key, document)``: the metrics as JSON fragments that merge to one document.

    One row per month, per sentiment and per source of the recent months, so that no row grows with the
    number of months or sources.
    """
    def fragment(table: DataFrame, part: str, key: str, value: Column) -> DataFrame:
        text = F.to_json(F.create_map(F.lit(part), F.create_map(F.col(key), value)), {"ignoreNullFields": "false"})
        return table.select(F.lit(part).alias("part"), F.col(key).alias("key"), text.alias("document"))

    months = monthly_metrics(rated, settings)
    sides = latest_sentiment(rated, settings).withColumn(
        "side", F.when(F.col("sentiment") == "pos", "positive").otherwise("negative"))
    sources = source_breakdown(rated, settings).groupBy("source").agg(  # a row per recent month: bounded
        F.array_sort(F.collect_list(F.struct("month", "avg_rating", "vol"))).alias("rows"))
    return (fragment(months, "months", "month", F.struct("avg_rating", "pos", "neg"))
            .unionByName(fragment(sides, "sentiment_breakdown", "side", F.struct("pct", "vol")))
            .unionByName(fragment(sources, "source_breakdown", "source", F.col("rows"))))
