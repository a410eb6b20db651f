"""Chat messages as rows: a main message with platforms and summaries as replies, one message per group with its items as replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.sql import filled
from plaudit.functions.text import plural
from plaudit.operators.items import group_share, group_summary
from plaudit.operators.ordinals import position_in_order
from plaudit.plans.decode import themes_sentence
from plaudit.plans.report import UNKNOWN_AUTHOR, platform_lines, shown_items, shown_stats

BLOCK = ("struct<type:string,text:struct<type:string,text:string,emoji:boolean>,"
         "elements:array<struct<type:string,text:string>>>")


def blocks_json(*blocks: str) -> Column:
    """JSON of a list of blocks, given as SQL structs; fields that are null are left out."""
    return F.expr(f"to_json(array({', '.join(f'cast({block} as {BLOCK})' for block in blocks)}))")


def text_block(kind: str, column: str, style: str = "mrkdwn", emoji: str = "null") -> str:
    return f"struct('{kind}', struct('{style}', {column}, {emoji}), null)"


DIVIDER = "struct('divider', null, null)"


def context_block(column: str) -> str:
    return f"struct('context', null, array(struct('mrkdwn', {column})))"


def section_json(column: str) -> Column:
    """A single text section as JSON."""
    return blocks_json(text_block("section", column))


def main_summary(themes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: the most frequent themes over all batches, of which there may be one or many."""
    return themes_sentence(themes, settings)


def joined_lines(order: str) -> Column:
    """The lines of a group in order, as one text."""
    lines = F.array_sort(F.collect_list(F.struct(order, "line")))
    return F.array_join(F.transform(lines, lambda row: row["line"]), "\n")


def platform_blocks(cube: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(block_no, text)``: the platform lines by source, a fixed number of them in each block.

    Lines are numbered range by range, so any number of sources makes blocks of the same size.
    """
    lines = position_in_order(platform_lines(cube, settings, chat=True), ["source"], "line_no")
    block = F.floor((F.col("line_no") - 1) / settings.lines_per_block) + 1
    return lines.groupBy(block.alias("block_no")).agg(joined_lines("line_no").alias("text"))


def main_blocks(cube: DataFrame, items: DataFrame, summary: DataFrame, source_name: str,
                generated: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One row ``(blocks_json)``: statistics, groups and the summary.

    ``cube`` is the ``review_cube`` of the export; ``summary`` has one row with the column ``summary``. The message has a
    line per configured group; the lines of the platforms follow as replies (``platform_blocks``).
    """
    groups = group_summary(items, settings).withColumn("line", filled("{emoji}  *{group_name}*: {n} reviews"))
    flagged = groups.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined_lines("group_ord").alias("lines")))
    gathered = shown_stats(cube, settings).select(
        "*", flagged.scalar().alias("flagged"), F.coalesce(summary.select("summary").scalar(), F.lit("")).alias("summary"))
    texts = gathered.select(
        "*", F.col("flagged.n").alias("flagged_n"), F.col("flagged.lines").alias("group_lines"),
    ).select(
        "summary", F.lit(settings.report_title).alias("title"),
        F.lit(f"Generated {generated}  |  Source: `{source_name}`").alias("origin"),
        filled("*Stats*\nTotal reviews in export: *{total}*  |  Avg rating: *★ {avg_text}*\n"
               "Date range: *{first_day} → {last_day}*\n\n*Per-platform breakdown:* see replies").alias("numbers"),
        filled(":warning: *Most Actionable Themes* ({flagged_n} flagged) — see threads below\n\n{group_lines}")
        .alias("themes"),
        F.lit(":bar_chart: *Sentiment Summary — Recurring Themes*").alias("summary_title"))
    return texts.select(blocks_json(
        text_block("header", "title", style="plain_text", emoji="true"), context_block("origin"),
        DIVIDER, text_block("section", "numbers"), DIVIDER, text_block("section", "themes"),
        DIVIDER, text_block("section", "summary_title"), text_block("section", "summary"),
    ).alias("blocks_json"))


def category_headers(cube: DataFrame, items: DataFrame, tops: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(group_ord, group_name, n, pct, text)``: count, share and the top item's review as example.

    ``tops`` are the first items of the groups with their reviews: those of ``reported`` with the group number 1, or
    ``top_item_per_group`` looked up by itself.
    """
    examples = shown_items(tops, settings).select(
        "group_ord", "shown_text",
        F.when(F.col("matched"), F.col("shown_author")).otherwise(UNKNOWN_AUTHOR).alias("by"))
    headers = group_share(items, cube, settings).join(F.broadcast(examples), "group_ord").withColumn("s", plural(F.col("n")))
    text = filled("{emoji} *{group_name}* — {n} actionable review{s} ({pct}% of negative reviews)\n\n"
                  "_Example: \"{shown_text}\" — {by}_")
    return headers.select("group_ord", "group_name", "n", "pct", text.alias("text"))


def item_blocks(found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(group_ord, group_item_no, category, text)`` per ``reported`` item, numbered within its group."""
    shown = shown_items(found, settings).withColumn(
        "link_line", F.coalesce(filled("\n<{link}|View review>"), F.lit("")))
    text = filled(
        "*[{group_item_no}] {shown_category}*  `{shown_score}/{top}  {bar}`\n"
        "*Source:* {shown_source}  |  *Rating:* {shown_stars}  |  *Author:* {shown_author}\n"
        "*Why actionable:* {shown_reason}\n_{shown_text}_{link_line}", top=settings.max_score)
    return shown.select("group_ord", "group_item_no", "category", text.alias("text"))


def message_stream(cube: DataFrame, found: DataFrame, summaries: DataFrame, themes: DataFrame, source_name: str,
                   generated: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``(group_ord, item_ord, parent_ord, text, blocks_json, unfurl_links, unfurl_media)``.

    ``cube`` is the ``review_cube`` of the export and ``found`` its ``reported`` items, both best written once.
    ``(0, 0)`` is the main message, ``(g, 0)`` the message of group ``g`` and ``(g, i)`` its replies;
    ``group_ord, item_ord`` is the posting order. The main message tells the most frequent themes; replies to it have the
    platforms, block by block, and then each batch's summary, in the same form at any size.
    """
    summary = main_summary(themes, settings)
    sources = cube.filter(F.col("source").isNotNull()).count()
    main = (main_blocks(cube, found, summary, source_name, generated, settings)
            .withColumn("text", F.lit(settings.report_title))
            .selectExpr("0 as group_ord", "0L as item_ord", "int(null) as parent_ord", "text", "blocks_json"))
    platforms = platform_blocks(cube, settings).select(
        F.lit(0).alias("group_ord"), F.col("block_no").alias("item_ord"), F.lit(0).alias("parent_ord"),
        filled("Platforms {block_no}").alias("text"), section_json("text").alias("blocks_json"))
    told = summaries.select(
        F.lit(0).alias("group_ord"), (F.col("batch_no") + -(-sources // settings.lines_per_block)).alias("item_ord"),
        F.lit(0).alias("parent_ord"),
        filled("Summary {batch_no}").alias("text"), section_json("summary").alias("blocks_json"))
    headers = category_headers(cube, found, found.filter("group_item_no = 1"), settings).select(
        "group_ord", F.expr("0L as item_ord"), F.expr("int(null) as parent_ord"),
        filled("{group_name} ({n} reviews)").alias("text"), section_json("text").alias("blocks_json"))
    replies = (item_blocks(found, settings).withColumn("category", F.coalesce("category", F.lit("")))
               .select("group_ord", F.col("group_item_no").alias("item_ord"), F.col("group_ord").alias("parent_ord"),
                       filled("[{group_item_no}] {category}").alias("text"),
                       section_json("text").alias("blocks_json")))
    posted = main.unionByName(platforms).unionByName(told).unionByName(headers).unionByName(replies)
    return posted.withColumns({"unfurl_links": F.lit(False), "unfurl_media": F.lit(False)})
