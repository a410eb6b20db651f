"""Month keys, tolerant date parsing and month labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaudit.config import DATE_FORMATS

MONTH_PATTERN = r"^\d{4}-\d{2}$"


def month_key(published: Column, validate: bool = False) -> Column:
    """First seven characters. Junk gives a junk month unless ``validate`` turns it into null."""
    key = F.coalesce(F.left(published, F.lit(7)), F.lit(""))
    return F.when(key.rlike(MONTH_PATTERN), key) if validate else key


def review_timestamp(published: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(published, F.lit(pattern)) for pattern in formats])


def day(timestamp: Column, missing: str) -> Column:
    return F.coalesce(F.date_format(timestamp, "yyyy-MM-dd"), F.lit(missing))


def month_label(month: Column) -> Column:
    """``2026-02`` as ``February``, line break, ``2026``; a junk month as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(month, F.lit("yyyy-MM")), "MMMM\nyyyy"), month)


def month_label_short(month: Column) -> Column:
    """``2026-02`` as ``Feb 2026``."""
    return F.coalesce(F.date_format(F.try_to_timestamp(month, F.lit("yyyy-MM")), "MMM yyyy"), month)
