"""Review exports (CSV), read as text by header name and typed in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.config import DEFAULTS, EXPORT_COLUMNS, Settings
from plaudit.functions.dates import MONTH_PATTERN, month_key
from plaudit.functions.ratings import coerce_rating, has_text, na_to_null, strict_rating
from plaudit.functions.text import is_blank, strip
from plaudit.sources.split_csv import POSITION, read_split_csv

CSV_QUOTING = {"quote": '"', "escape": '"'}


def read_export(spark: SparkSession, paths: str | list[str], multi_line: bool = True, split: bool = True,
                positions: bool = False) -> DataFrame:
    """Raw rows of one or more exports, every column as text.

    Quoted line breaks need ``multi_line``. Files are then split into ranges whose quotes are counted first
    (``split_csv``); ``split=False`` leaves each file to one task of Spark's own reader. Headers are
    checked per file; a file with another column order fails instead of being read by position.
    ``positions`` adds the place of a row in the export: ``file, range, line``, to be sorted by in this order.
    """
    raw = spark.read.csv(paths, header=True, multiLine=multi_line, enforceSchema=False, **CSV_QUOTING)
    if multi_line and split or positions:
        raw = read_split_csv(spark, paths, raw.columns, CSV_QUOTING)
    named = raw.toDF(*[name.strip() for name in raw.columns])
    return named.select(*[F.col(f"`{header}`").alias(name) for header, name in EXPORT_COLUMNS], *(POSITION if positions else ()))


def write_export(raw: DataFrame, path: str) -> None:
    """Write raw rows under the export's header, one file per partition."""
    named = raw.select(*[F.col(name).alias(header) for header, name in EXPORT_COLUMNS])
    named.write.mode("error").csv(path, header=True, ignoreLeadingWhiteSpace=False,
                                  ignoreTrailingWhiteSpace=False, **CSV_QUOTING)


def _month(raw: DataFrame) -> Column:
    """The month column of a staged table, which prunes its folders, else the date's first part."""
    return F.coalesce("month", F.lit("")) if "month" in raw.columns else month_key(F.col("published"))


def text_given(rows: DataFrame, flag: str) -> Column:
    """The flag of a staged table, which spares reading the text, else a look at the text."""
    return F.col(flag) if flag in rows.columns else has_text(F.col("review"))


def coerced(raw: DataFrame) -> DataFrame:
    """All rows, tolerant dialect: missing-value tokens and bad ratings become null."""
    cleaned = [na_to_null(name).alias(name) for _, name in EXPORT_COLUMNS if name in raw.columns]
    flags = [name for name in ("known_text",) if name in raw.columns]
    return (raw.select(*cleaned, *flags, _month(raw).alias("month"))
            .withColumn("rating", coerce_rating(F.col("rating_raw"))))


def rejected_ratings(raw: DataFrame) -> DataFrame:
    """Rows whose rating is given but is not a number; the tolerant dialect counts them as unrated."""
    given = na_to_null("rating_raw")
    return raw.filter(given.isNotNull() & ~is_blank(given) & coerce_rating(given).isNull())


def analysable(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Coerced rows rated up to the cutoff that have text."""
    return reviews.filter(is_analysable(reviews, settings))


def is_analysable(reviews: DataFrame, settings: Settings) -> Column:
    return (F.col("rating") <= settings.rating_cutoff) & text_given(reviews, "known_text")


def placed(rows: DataFrame) -> list[str]:
    """The columns that tell where a row stands in the export, if it was read with them."""
    return list(POSITION) if set(POSITION) <= set(rows.columns) else []


def _valid_months(rows: DataFrame, validate_month: bool) -> DataFrame:
    return rows.filter(F.col("month").rlike(MONTH_PATTERN)) if validate_month else rows


def rated_text(raw: DataFrame, validate_month: bool = False) -> DataFrame:
    """Strict dialect: rows with a rating and a text, both stripped; a bad rating is an error.

    The rating of a row without text is never parsed. ``validate_month`` leaves out rows whose date
    does not start with a month, which else form months of their own that sort last.
    """
    usable = ~is_blank(F.col("rating_raw")) & text_given(raw, "has_text")
    rows = raw.filter(usable).select(
        "review_id",
        strip(F.col("review")).alias("review"),
        F.when(usable, strict_rating(F.col("rating_raw"))).alias("rating"),
        _month(raw).alias("month"), *placed(raw),
    )
    return _valid_months(rows, validate_month)


def rated(raw: DataFrame, validate_month: bool = False) -> DataFrame:
    """Strict dialect: ``(month, rating, source)`` of rows with any rating; text does not matter."""
    given = F.coalesce(F.length("rating_raw") > 0, F.lit(False))
    rows = raw.filter(given).select(
        _month(raw).alias("month"),
        F.when(given, strict_rating(F.col("rating_raw"))).alias("rating"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
    )
    return _valid_months(rows, validate_month)
