"""Category tables: picks by confidence, validity, counts, month grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.config import DEFAULTS, OTHER, Settings


def vocabulary(sentiment: str, settings: Settings) -> tuple[str, ...]:
    return settings.positive_categories if sentiment == "pos" else settings.negative_categories


def top_candidates(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The most likely categories per review: ``(review_id, ord, category, confidence, nth)``.

    The rank limit works before the shuffle too, so a review id with many rows stays small.
    """
    likely = Window.partitionBy("review_id").orderBy(F.desc("confidence"), "ord")
    return (candidates.withColumn("nth", F.row_number().over(likely))
            .filter(F.col("nth") <= settings.top_candidates))


def pick_category(candidates: DataFrame, settings: Settings = DEFAULTS,
                  tie_seed: int | None = None) -> DataFrame:
    """One category per review: the highest confidence if it is above the limit, else ``other``.

    A tie goes to the earlier category, or to a reproducible random one with ``tie_seed``. The
    best row is kept by partial aggregation, without a sort of all candidates.
    """
    if tie_seed is None:
        preference = -F.col("ord").cast("long")
    else:
        preference = F.xxhash64(F.lit(tie_seed), "review_id", "ord")
    best = candidates.groupBy("review_id").agg(F.max(F.struct(
        F.col("confidence"), preference.alias("preference"), F.col("category"))).alias("best"))
    return best.select("review_id", picked(F.col("best"), settings).alias("category"))


def picked(best: Column, settings: Settings) -> Column:
    """Category of the best candidate struct, or ``other`` when it is not confident enough."""
    return (F.when(best["confidence"] > settings.min_confidence, best["category"])
            .otherwise(F.lit(OTHER)))


def category_valid(categorised: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``valid``: the category is in the list of the row's sentiment."""
    valid = F.when(F.col("sentiment") == "pos", F.col("category").isin(*settings.positive_categories)) \
        .otherwise(F.col("category").isin(*settings.negative_categories))
    return categorised.withColumn("valid", F.coalesce(valid, F.lit(False)))


def category_counts(categorised: DataFrame) -> DataFrame:
    return categorised.groupBy("sentiment", "month", "category").agg(F.count("*").alias("n"))


def category_union(categorised: DataFrame) -> DataFrame:
    """Categories of a sentiment over all its months."""
    return categorised.select("sentiment", "category").distinct()


def first_months(counts: DataFrame, count: int = 2) -> DataFrame:
    """``(sentiment, months)``: the first months of a sentiment as an array, ``count`` long at most."""
    order = Window.partitionBy("sentiment").orderBy("month")
    # The totals keep the plan equal to the one of the counts, so that their exchange is reused.
    totals = counts.groupBy("sentiment", "month").agg(F.sum("n").alias("total")).filter(F.col("total") > 0)
    kept = totals.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= count)
    return kept.groupBy("sentiment").agg(F.array_sort(F.collect_list("month")).alias("months"))


def month_pairs(counts: DataFrame) -> DataFrame:
    """``(sentiment, category, month_1, n_1, month_2, n_2)``: first two months, absent pairs are 0.

    Works on the counts, which have one row per category and month; a category of a later month
    still gets its row. With one month only, ``month_2`` is null and ``n_2`` is 0.
    """
    def matching(place: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("month") == F.col(place), F.col("n"))), F.lit(0))

    months = first_months(counts).select(
        "sentiment", F.get("months", F.lit(0)).alias("month_1"), F.get("months", F.lit(1)).alias("month_2"))
    return (counts.join(months, "sentiment").groupBy("sentiment", "category", "month_1", "month_2")
            .agg(matching("month_1").alias("n_1"), matching("month_2").alias("n_2")))


def category_grid(counts: DataFrame) -> DataFrame:
    """``(sentiment, category, month, n)``: every category of a sentiment with each of its months, 0 where absent."""
    months = counts.groupBy("sentiment").agg(F.array_sort(F.collect_set("month")).alias("months"))
    own = counts.groupBy("sentiment", "category").agg(F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("by_month"))
    cells = own.join(months, "sentiment").select("sentiment", "category", "by_month", F.explode("months").alias("month"))
    return cells.select("sentiment", "category", "month", F.coalesce(F.try_element_at("by_month", "month"), F.lit(0)).alias("n"))
