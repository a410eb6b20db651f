"""The runs of the library from an export to their results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.operators.batching import bucket_reviews
from plaudit.operators.categories import category_counts
from plaudit.operators.items import actionable, in_score_range, reported
from plaudit.operators.metrics import review_cube
from plaudit.operators.scoring import ACTIONABLE_LEXICON, Lexicon, listed_items, score_actionability
from plaudit.plans.charts import chart_categories, chart_monthly, chart_two_sources
from plaudit.plans.decode import (
    decode_analysis, decode_categories, parse_analysis, rejected_categories, rejected_category_entries, rejected_entries,
    rejected_responses, summaries, theme_counts, themes_sentence, unanswered)
from plaudit.plans.messages import message_stream
from plaudit.plans.prompts import analysis_prompts, categorise_prompts
from plaudit.plans.report import report_lines
from plaudit.plans.responder import Responder, answered, failed_prompts
from plaudit.sources.exports import analysable, coerced, rated, rated_text, rejected_ratings
from plaudit.sources.staging import written


@dataclass(frozen=True)
class AnalysisResult:
    items: DataFrame                # actionable items
    themes: DataFrame
    report: DataFrame               # lines of the text report
    messages: DataFrame
    rejected_items: DataFrame | None = None      # scores outside the range; the report prints such items too
    rejected_entries: DataFrame | None = None    # entries of answers that are no items
    rejected_responses: DataFrame | None = None  # answers that could not be parsed
    rejected_ratings: DataFrame | None = None    # ratings that are no numbers, counted as unrated
    failed_prompts: DataFrame | None = None      # prompts without an answer, with the error


def analyse(spark: SparkSession, raw: DataFrame, responder: Responder, store: str, source_name: str,
            generated: str, settings: Settings = DEFAULTS) -> AnalysisResult:
    """Flag actionable reviews of an export and lay out the report.

    ``raw`` comes from ``read_export`` or, for large exports, from a staged table. Everything after
    the responder starts from the stored answers, which are parsed once.
    """
    reviews = coerced(raw)
    analysed = analysable(reviews, settings)
    answers = answered(spark, analysis_prompts(analysed, settings), responder, store)
    responses = written(spark, parse_analysis(answers.filter("response is not null")), "answers")
    found = decode_analysis(responses)
    items = actionable(found, settings)
    told, themes = summaries(responses), theme_counts(responses)
    cube, shown = written(spark, review_cube(reviews, settings), "cube"), reported(items, analysed, settings)
    return AnalysisResult(
        items=items, themes=themes,
        report=report_lines(cube, shown, told, source_name, generated, settings),
        messages=message_stream(cube, shown, told, themes, source_name, generated, settings),
        rejected_items=found.filter(~in_score_range(settings)),
        rejected_entries=rejected_entries(responses),
        rejected_ratings=rejected_ratings(raw),
        rejected_responses=rejected_responses(responses),
        failed_prompts=failed_prompts(answers))


def analyse_by_rules(spark: SparkSession, raw: DataFrame, source_name: str, generated: str,
                     lexicon: Lexicon = ACTIONABLE_LEXICON, settings: Settings = DEFAULTS) -> AnalysisResult:
    """The same report without a responder: items by terms, most frequent categories as summary."""
    reviews = coerced(raw)
    analysed = analysable(reviews, settings)
    scored = written(spark, score_actionability(analysed, lexicon, settings), "items")
    items = actionable(listed_items(scored, settings), settings)
    themes = scored.groupBy(F.col("category").alias("theme")).agg(F.count("*").alias("n"))
    told = themes_sentence(themes, settings).select(F.lit(1).cast("long").alias("batch_no"), "summary")
    cube, shown = written(spark, review_cube(reviews, settings), "cube"), reported(items, analysed, settings)
    return AnalysisResult(
        items=items, themes=themes,
        report=report_lines(cube, shown, told, source_name, generated, settings),
        messages=message_stream(cube, shown, told, themes, source_name, generated, settings))


@dataclass(frozen=True)
class CategoriesResult:
    categorised: DataFrame          # sentiment, batch_no, month, item_no, review_id, category
    rejected_responses: DataFrame
    asked: DataFrame                # sentiment, month, review_id, review
    rejected_entries: DataFrame     # sentiment, batch_no, month, entry
    unanswered: DataFrame           # asked reviews that no answer gave a category
    failed_prompts: DataFrame       # prompts without an answer, with the error


def categorise_export(spark: SparkSession, raw: DataFrame, responder: Responder, store: str,
                      settings: Settings = DEFAULTS, validate_month: bool = False) -> CategoriesResult:
    """Ask for a category for every review of the recent months.

    ``validate_month`` keeps junk dates, which sort last, from displacing real months.
    """
    asked = bucket_reviews(rated_text(raw, validate_month), settings)
    answers = answered(spark, categorise_prompts(asked, settings), responder, store)
    responses = answers.filter("response is not null")
    found = decode_categories(responses)
    return CategoriesResult(found, rejected_categories(responses), asked, rejected_category_entries(responses),
                            unanswered(asked, found), failed_prompts(answers))


def deck(raw: DataFrame, categorised: DataFrame, settings: Settings = DEFAULTS,
         validate_month: bool = False) -> dict[str, DataFrame]:
    """The four chart tables."""
    ratings, counts = rated(raw, validate_month), category_counts(categorised)
    return {
        "monthly": chart_monthly(ratings, settings),
        "two_sources": chart_two_sources(ratings, settings),
        "positive_categories": chart_categories(counts, "pos"),
        "negative_categories": chart_categories(counts, "neg"),
    }
