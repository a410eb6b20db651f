"""Actionable items: ``(batch_no, pos, review_id, score, category, reason)``.

``batch_no`` is the response an item came from and ``pos`` its place in it; both together give the
order of the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.numbers import percent
from plaudit.functions.sql import quoted
from plaudit.functions.text import prefix
from plaudit.operators.joins import bucketed_lookup, latest_per_key
from plaudit.operators.metrics import cube_negatives
from plaudit.operators.ordinals import running_position
from plaudit.sources.staging import written

LIST_ORDER = ["batch_no", "pos", "review_id", "category", "reason"]  # the latter only settle ties
BATCHES_PER_SPAN = 1_000


def with_span(items: DataFrame, batches_per_span: int = BATCHES_PER_SPAN) -> DataFrame:
    """Pieces of bounded size that follow the list order."""
    return items.withColumn("span", F.floor(F.col("batch_no") / batches_per_span))


def in_score_range(settings: Settings = DEFAULTS) -> Column:
    """A missing score counts as 0."""
    return F.coalesce(F.col("score"), F.lit(0)).between(0, settings.max_score)


def actionable(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Items that score high enough."""
    return items.filter(F.col("score") >= settings.min_score)


def ranked(items: DataFrame, settings: Settings = DEFAULTS,
           batches_per_span: int = BATCHES_PER_SPAN) -> DataFrame:
    """Add ``item_no``: 1 for the first item by score (high first, any number), then list order."""
    level = -F.coalesce(F.col("score"), F.lit(0))
    return (running_position(with_span(items, batches_per_span).withColumns({"level": level, "scope": F.lit(0)}),
                             ["scope"], ["level", "span"], LIST_ORDER, "item_no")
            .drop("scope", "level", "span", "group_rows"))


def group_case(field: int, settings: Settings) -> Column:
    """0: order, 1: name, 2: emoji of the first group with a keyword in the lower-cased category."""
    values = [(str(at), quoted(name), quoted(emoji)) for at, (name, emoji, _) in enumerate(settings.groups, 1)]
    cases = [f"when {' or '.join(f'contains(lower(category), {quoted(word)})' for word in words)} then {value[field]}"
             for value, (_, _, words) in zip(values, settings.groups[:-1]) if words]
    return F.expr(f"case {' '.join([*cases, 'when true then ' + values[-1][field]])} end")


def assign_group(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``group_ord, group_name, emoji``; what matches no group belongs to the last one."""
    return items.withColumns({name: group_case(field, settings)
                              for field, name in enumerate(("group_ord", "group_name", "emoji"))})


def group_summary(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Items per group; a group without items has no row. Order by ``group_ord``."""
    return (assign_group(items, settings).groupBy("group_ord", "group_name", "emoji")
            .agg(F.count("*").alias("n")))


def group_share(items: DataFrame, cube: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Groups with their share of all negative reviews (``review_cube``) in whole percent; may exceed 100."""
    total = cube_negatives(cube).scalar()
    return (group_summary(items, settings).withColumn("total_neg", total)
            .withColumn("pct", percent("n", "total_neg")))


def item_ordinals(items: DataFrame, settings: Settings = DEFAULTS,
                  batches_per_span: int = BATCHES_PER_SPAN) -> DataFrame:
    """Add ``item_no`` over all items (by score) and ``group_item_no`` within the group (same order)."""
    grouped = assign_group(ranked(items, settings, batches_per_span), settings)
    return in_group_order(grouped, batches_per_span)


def in_group_order(grouped: DataFrame, batches_per_span: int = BATCHES_PER_SPAN) -> DataFrame:
    """Add ``group_item_no``: place within the group by score (high first), then list order."""
    level = -F.coalesce(F.col("score"), F.lit(0))
    return (running_position(with_span(grouped, batches_per_span).withColumn("level", level),
                             ["group_name"], ["level", "span"], LIST_ORDER, "group_item_no")
            .drop("span", "level", "group_rows"))


def top_item_per_group(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Highest score per group, the first in the list on ties; a missing score counts as 0."""
    score = F.coalesce(F.col("score"), F.lit(0))
    best = Window.partitionBy("group_name").orderBy(score.desc(), *LIST_ORDER)
    return (assign_group(items, settings).withColumn("nth", F.row_number().over(best))
            .filter("nth = 1").drop("nth"))


def review_lookup(reviews: DataFrame, settings: Settings = DEFAULTS, used: DataFrame | None = None) -> DataFrame:
    """One row per review id, the latest, with what a report shows of it; only of ids in ``used`` if given.

    Only the head of a text travels: one character more than a snippet shows.
    """
    head = prefix(F.col("review"), settings.snippet_chars + 1)
    shown = reviews.filter(F.col("review_id").isNotNull()).select(
        "review_id", "published", "author", "source", "rating", head.alias("review"), "url")
    if used is not None:
        shown = shown.join(used, "review_id", "left_semi")
    return latest_per_key(shown, "review_id", [
        F.desc_nulls_last("published"), "author", "source", "rating", "review", "url"])


def with_reviews(items: DataFrame, reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Items with the columns of ``review_lookup`` and ``matched``; unmatched items stay."""
    return bucketed_lookup(items, lambda used: review_lookup(reviews, settings, used), "review_id", ["batch_no", "pos"])


def reported(items: DataFrame, reviews: DataFrame, settings: Settings = DEFAULTS,
             batches_per_span: int = BATCHES_PER_SPAN) -> DataFrame:
    """Items as a report needs them, written once: numbers and groups, then the review each refers to.

    Numbers are computed before the join, on rows without a review; report lines, headers and
    replies all read the result and join nothing.
    """
    spark = items.sparkSession
    numbered = item_ordinals(written(spark, items, "items"), settings, batches_per_span)
    return written(spark, with_reviews(written(spark, numbered, "numbered"), reviews, settings), "reported")
