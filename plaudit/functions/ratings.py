"""Rating parsing in both dialects, sentiment, source and link rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaudit.config import NA_TOKENS, Settings
from plaudit.functions.sql import quoted_list
from plaudit.functions.text import is_blank, strip

# A decimal number; keeps out what a cast would take besides: 5d, 5f, NaN, Infinity.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def na_to_null(column: str) -> Column:
    """A text column with null for the tokens that stand for a missing value."""
    return F.expr(f"case when `{column}` not in ({quoted_list(NA_TOKENS)}) then `{column}` end")


def coerce_rating(raw: Column) -> Column:
    """Number, or null when it is not one."""
    return F.when(strip(raw).rlike(NUMBER), strip(raw).try_cast("double"))


def strict_rating(raw: Column) -> Column:
    """Number, or an error that fails the job."""
    return (F.when(raw.isNull(), None)
            .when(strip(raw).rlike(NUMBER), strip(raw).cast("double"))
            .otherwise(F.raise_error(F.concat(F.lit("rating is not a number: "), raw)).cast("double")))


def is_positive(rating: Column, settings: Settings) -> Column:
    return rating >= settings.positive_from


def two_way(rating: Column, settings: Settings) -> Column:
    """``pos`` or ``neg``; null without a rating."""
    return F.when(is_positive(rating, settings), "pos").when(rating.isNotNull(), "neg")


def rated_side(rating: Column, settings: Settings) -> Column:
    """``two_way`` for rows that all have a rating; never null, so that keys need no null filter."""
    return F.when(is_positive(rating, settings), "pos").otherwise("neg")


def three_way(rating: Column, settings: Settings) -> Column:
    """``pos``, ``neg``, or null for ratings in between and for none."""
    return (F.when(is_positive(rating, settings), "pos")
            .when(rating <= settings.negative_upto, "neg"))


def is_excluded(source: Column, settings: Settings) -> Column:
    """Sources left out of aggregates; a missing source is not one of them."""
    return F.coalesce(source, F.lit("")).isin(*settings.excluded_sources)


def review_link(source: Column, review_id: Column, url: Column, settings: Settings) -> Column:
    """Link built from the id for platforms without links, else the URL; null for an empty one."""
    link = (F.when(source.isin(*settings.unlinked_sources), F.concat(F.lit(settings.link_base), review_id))
            .otherwise(url))
    return F.when(F.length(link) > 0, link)


def has_text(review: Column) -> Column:
    return ~is_blank(review)
