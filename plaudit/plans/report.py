"""The text report as ordered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.dates import day
from plaudit.functions.numbers import fixed
from plaudit.functions.ratings import review_link
from plaudit.functions.sql import filled, quoted
from plaudit.functions.text import score_bar, snippet, stars
from plaudit.operators.metrics import cube_platforms, cube_stats

RULE = "━" * 60
REPORT_ORDER = ["section_ord", "sort_text", "line_ord"]

# What an item shows of a review that is not in the export.
UNMATCHED = "N/A"
UNKNOWN_RATING = "?"
UNKNOWN_AUTHOR = "Unknown"

REPORT_PLATFORM = "    {source}: {total} reviews  |  ★ avg {avg_text}  |  👍 {pos} ({pos_pct}%)  👎 {neg} ({neg_pct}%)"
CHAT_PLATFORM = ("  • *{source}*: {total} reviews  |  ★ avg {avg_text}  |  :thumbsup: {pos} ({pos_pct}%)"
                 "  :thumbsdown: {neg} ({neg_pct}%)")


def platform_lines(cube: DataFrame, settings: Settings = DEFAULTS, chat: bool = False) -> DataFrame:
    """``(source, line)`` of a ``review_cube`` for the text report, or for a chat message with ``chat``."""
    stats = cube_platforms(cube).withColumn(
        "avg_text", fixed("avg_rating", 1, settings.missing_text))
    return stats.select("source", filled(CHAT_PLATFORM if chat else REPORT_PLATFORM).alias("line"))


def shown_stats(cube: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``cube_stats`` with the mean and the dates as text."""
    return cube_stats(cube).select(
        "total", fixed("avg_rating", 2, settings.missing_text).alias("avg_text"),
        day(F.col("first_ts"), UNMATCHED).alias("first_day"), day(F.col("last_ts"), UNMATCHED).alias("last_day"))


def shown_items(joined: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Items joined to their reviews, with every field as a report shows it; only ``link`` may be null."""
    def field(name: str, unmatched: str) -> Column:
        return F.expr(f"if(matched, coalesce({name}, {quoted(settings.missing_text)}), {quoted(unmatched)})")

    score = F.coalesce("score", F.lit(0))
    return joined.withColumns({
        "shown_score": score,
        "bar": score_bar(score),
        "shown_category": F.coalesce("category", F.lit("")),
        "shown_reason": F.coalesce("reason", F.lit("")),
        "shown_source": field("source", UNMATCHED),
        "shown_author": field("author", UNMATCHED),
        "shown_date": field("published", UNMATCHED),
        "shown_stars": F.coalesce(stars(F.col("rating")), F.lit(UNKNOWN_RATING)),
        "shown_text": snippet(field("review", ""), settings.snippet_chars),
        "link": review_link(F.col("source"), F.col("review_id"), F.col("url"), settings),
    })


def _lines(section: int, *lines: str | Column) -> Column:
    """Numbered lines of one section as an array of rows."""
    texts = F.array(*[F.lit(line) if isinstance(line, str) else line for line in lines])
    return F.transform(texts, lambda line, at: F.struct(
        F.lit(section).alias("section_ord"), F.lit("").alias("sort_text"),
        at.cast("long").alias("line_ord"), line.alias("line")))


def item_lines(found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(item_no, line_no, line)`` of ``reported`` items: six or seven lines per item, highest score first."""
    shown = shown_items(found, settings)
    lines = F.array(
        F.lit(""),
        filled("  [{item_no}] Actionability: {shown_score}/{top}  {bar}  |  {shown_category}", top=settings.max_score),
        filled("      Source: {shown_source}  |  Rating: {shown_stars}  |  Author: {shown_author}"),
        filled("      Date:   {shown_date}"),
        filled("      WHY:    {shown_reason}"),
        filled("      Review: \"{shown_text}\""),
        filled("      URL:    {link}"),
    )
    return (shown.select("item_no", F.posexplode(lines).alias("line_no", "line"))
            .filter(F.col("line").isNotNull()))


def report_lines(cube: DataFrame, found: DataFrame, summaries: DataFrame,
                 source_name: str, generated: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``(section_ord, sort_text, line_ord, line)``, to be ordered by the first three.

    ``cube`` is the ``review_cube`` of the export and ``found`` its ``reported`` items, both best written once. With several
    batches every summary is a line of its own. ``generated`` is the run time as text.
    """
    head = shown_stats(cube, settings).select(F.inline(_lines(
        1, "", RULE, f"  {settings.report_title.upper()}",
        f"  Generated: {generated}  |  Source: {source_name}", RULE, "", "STATS",
        filled("  Total reviews in export:          {total}"),
        filled("  Avg star rating:                  ★ {avg_text}"),
        filled("  Date range:                       {first_day} → {last_day}"),
        "", "  Per-platform breakdown:")))
    platforms = platform_lines(cube, settings).selectExpr(
        "2 as section_ord", "source as sort_text", "0L as line_ord", "line")
    flagged = found.agg(F.count("*").alias("n")).select("n", F.inline(F.concat(
        _lines(3, "", RULE, filled("  MOST ACTIONABLE THEMES  ({n} flagged)"), RULE),
        _lines(4, "", "  No actionable items identified.", ""),
        _lines(5, "", RULE, "  SENTIMENT SUMMARY — Recurring Themes", RULE, ""),
        _lines(7, "", RULE, ""))))
    frame = flagged.filter("n = 0 or section_ord <> 4").drop("n")
    listed = item_lines(found, settings).selectExpr(
        "4 as section_ord", "'' as sort_text", "item_no * 10 + line_no as line_ord", "line")
    told = summaries.select(F.lit(6).alias("section_ord"), F.lit("").alias("sort_text"),
                            F.col("batch_no").alias("line_ord"), filled("  {summary}").alias("line"))
    return reduce(DataFrame.unionByName, [head, platforms, frame, listed, told])
