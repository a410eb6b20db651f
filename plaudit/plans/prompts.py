"""Prompts: batches of reviews as text for a responder, one row per prompt."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.numbers import text_or
from plaudit.functions.text import prefix
from plaudit.operators.batching import assign_batches, sentiment_batches
from plaudit.operators.categories import vocabulary
from plaudit.sources.documents import month_map

BLOCK_SEPARATOR = "\n\n---\n\n"

ANALYSIS_FORMAT = """{
  "summary": "<two or three sentences on the most common themes>",
  "theme_counts": {"<theme>": <number of reviews>},
  "actionable_items": [
    {"review_id": "<id>", "actionability_score": <1-5>, "category": "<label>", "reason": "<one sentence>"}
  ]
}"""

CATEGORY_FORMAT = """{"<YYYY-MM>": [{"review_id": "<id>", "category": "<category>"}]}"""


def analysis_frame(settings: Settings = DEFAULTS) -> tuple[str, str, str]:
    """Text before the number of reviews, between number and reviews, and after them."""
    labels = ", ".join(json.dumps(label) for label in settings.actionable_labels)
    before = (
        f"Task: read customer reviews of {settings.company} and pick out what a team can act on.\n"
        "A review is an item if it names a concrete problem that someone could reproduce, trace or repair. "
        f"Score each item from 1 (hardly) to {settings.max_score} (at once) by how clearly it says what went wrong. "
        "Opinions without such a problem are no items.\n\nNumber of reviews: ")
    after = (
        f"\n\nAnswer with a JSON object of this form only:\n{ANALYSIS_FORMAT}\n\n"
        f"List an item only if its score is {settings.min_score} or more, highest score first. "
        "Count themes over all reviews, also those without an item.\n"
        f"Use these labels where one fits: {labels}.\n")
    return before, "\n\n", after


def category_frame(sentiment: str, settings: Settings = DEFAULTS) -> tuple[str, str]:
    """Text before and after the reviews."""
    names = ", ".join(json.dumps(name) for name in vocabulary(sentiment, settings))
    kind = "positive" if sentiment == "pos" else "negative"
    before = f"These are {kind} customer reviews of {settings.company}, by month:\n\n"
    after = (
        f"\n\nGive every review one category of this list:\n[{names}]\n\n"
        f"Rate the {settings.top_candidates} most likely categories of a review with a confidence "
        f"from 0 to 100 each. Take the most confident one if it is above {settings.min_confidence}, "
        "any of them on a tie, and \"other\" if none is.\n\n"
        f"Answer with a JSON object of this form only:\n{CATEGORY_FORMAT}\n")
    return before, after


def review_block(settings: Settings = DEFAULTS) -> Column:
    """One review as the analysis prompt shows it."""
    def shown(name: str) -> Column:
        return text_or(F.col(name).cast("string"), settings.missing_text)

    return F.concat(
        F.lit("[ID: "), shown("review_id"), F.lit("]\nSource: "), shown("source"),
        F.lit(" | Rating: "), shown("rating"), F.lit("★ | Author: "), shown("author"),
        F.lit("\nTitle: "), shown("title"),
        F.lit("\nReview: "), prefix(F.col("review"), settings.prompt_chars))


def _with_hash(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256))


def analysis_prompts(analysable: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(batch_no, total_batches, n_reviews, prompt, prompt_hash)``; a prompt holds one batch."""
    before, between, after = analysis_frame(settings)
    blocks = analysable.select("review_id", review_block(settings).alias("block"))
    batches = assign_batches(blocks, [], [], settings.batch_size)
    rows = F.array_sort(F.collect_list(F.struct("row_no", "block")))
    joined = F.array_join(F.transform("rows", lambda row: row["block"]), BLOCK_SEPARATOR)
    return _with_hash(
        batches.groupBy("batch_no")
        .agg(F.max("total_batches").alias("total_batches"), rows.alias("rows"))
        .withColumn("n_reviews", F.size("rows").cast("long"))
        .select("batch_no", "total_batches", "n_reviews",
                F.concat(F.lit(before), F.col("n_reviews").cast("string"), F.lit(between), joined,
                         F.lit(after)).alias("prompt")))


def categorise_prompts(buckets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(sentiment, batch_no, total_batches, n_reviews, prompt, prompt_hash)``, reviews as JSON by month."""
    batches = sentiment_batches(buckets, settings)
    entry = F.struct("row_no", "month", F.struct("review_id", "review").alias("row"))
    reviews = F.to_json(month_map(F.col("rows")), {"ignoreNullFields": "false"})
    frames = {side: category_frame(side, settings) for side in ("pos", "neg")}

    def framed(at: int) -> Column:
        return F.when(F.col("sentiment") == "pos", frames["pos"][at]).otherwise(frames["neg"][at])

    return _with_hash(
        batches.groupBy("sentiment", "batch_no")
        .agg(F.max("total_batches").alias("total_batches"),
             F.array_sort(F.collect_list(entry)).alias("rows"))
        .select("sentiment", "batch_no", "total_batches", F.size("rows").cast("long").alias("n_reviews"),
                F.concat(framed(0), reviews, framed(1)).alias("prompt")))
