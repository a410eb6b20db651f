"""One query per operator: ``name -> (spark, folder of the tables) -> DataFrame``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.catalog import fixture as fx
from plaudit.config import DEFAULTS
from plaudit.functions import ratings, text as tx
from plaudit.functions.dates import day, month_label, month_label_short, review_timestamp
from plaudit.functions.numbers import fixed, percent, round_exact
from plaudit.functions.ratings import is_excluded, three_way, two_way
from plaudit.operators import batching, categories, items as it, metrics, months, scoring
from plaudit.plans import charts, decode, flows, messages, prompts, report
from plaudit.plans.responder import answered
from plaudit.session import scratch_path
from plaudit.sources import documents
from plaudit.sources.exports import coerced, rated_text, read_export, write_export
from plaudit.sources.staging import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Sources and sinks ----------------------------------------------------------------------------


@query
def scan_reviews_coerce(spark, sf):
    path = scratch_path(spark, "export")
    write_export(fx.raw_reviews(spark, sf), path)
    return coerced(read_export(spark, path)).select(
        "review_id", "published", "author", "source", "rating", "title", "review", "url")


@query
def scan_reviews_strict(spark, sf):
    path = scratch_path(spark, "export")
    write_export(fx.strict_raw(spark, sf), path)
    return rated_text(read_export(spark, path))


@query
def read_categorized_json(spark, sf):
    path = scratch_path(spark, "categorised")
    batches = scoring.categorised_batches(fx.categorised(spark, sf))
    documents.write_lines(documents.categorised_document(batches), "document", path, ["sentiment", "batch_no"])
    return documents.read_categorised(spark, path, multi_line=False).select(
        "sentiment", "month", "review_id", "category")


@query
def categorized_document(spark, sf):
    return documents.categorised_document(scoring.categorised_batches(fx.categorised(spark, sf)))


@query
def metrics_document(spark, sf):
    return metrics.metrics_document(fx.strict_rated(spark, sf))


def _found(spark, sf):
    return it.actionable(fx.items(spark, sf))


def _cube(spark, sf):
    return written(spark, metrics.review_cube(fx.reviews(spark, sf)), "cube")


def _reported(spark, sf):
    return it.reported(_found(spark, sf), fx.analysed(spark, sf))


@query
def report_lines(spark, sf):
    told = decode.summaries(fx.analysis_responses(spark, sf))
    return report.report_lines(_cube(spark, sf), _reported(spark, sf), told, fx.EXPORT_NAME, fx.RUN_TIME)


@query
def analysis_report(spark, sf):
    """The whole run from a raw export to its report, with items by the terms in the texts."""
    return flows.analyse_by_rules(spark, fx.raw_reviews(spark, sf), fx.EXPORT_NAME, fx.RUN_TIME, fx.ACTIONABLE_TERMS).report


@query
def message_stream(spark, sf):
    responses = written(spark, decode.parse_analysis(fx.analysis_responses(spark, sf)), "answers")
    return messages.message_stream(
        _cube(spark, sf), _reported(spark, sf), decode.summaries(responses), decode.theme_counts(responses),
        fx.EXPORT_NAME, fx.RUN_TIME)


@query
def run_responder(spark, sf):
    def by_term(prompt: str) -> str:
        """Answers a categorisation prompt: one term decides."""
        listed = prompt.split("by month:\n\n", 1)[1].rsplit("\n\nGive every review", 1)[0]
        picked = {month: [{"review_id": row["review_id"],
                           "category": "credit card" if "the" in row["review"].lower() else "other"}
                          for row in rows] for month, rows in json.loads(listed).items()}
        return f"```json\n{json.dumps(picked)}\n```"

    asked = prompts.categorise_prompts(batching.bucket_reviews(fx.strict_text(spark, sf)))
    return decode.merge_responses(answered(spark, asked, by_term, scratch_path(spark, "responses")))


# Projections and filters ----------------------------------------------------------------------


@query
def rating_coerce(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "rating")


@query
def null_tokens(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "source", "title", "review", "rating_raw")


@query
def filter_analysable(spark, sf):
    return fx.analysed(spark, sf, author=False, url=False).select("review_id", "source", "rating", "review")


@query
def filter_rated_text(spark, sf):
    return fx.strict_text(spark, sf).select("review_id", "rating", "month", "review")


@query
def filter_rated(spark, sf):
    return fx.strict_rated(spark, sf)


@query
def month_key(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "month")


@query
def truncate_text(spark, sf):
    return fx.reviews(spark, sf).select(
        "review_id", tx.prefix(F.col("review"), DEFAULTS.prompt_chars).alias("review_cut"))


@query
def snippet(spark, sf):
    return fx.reviews(spark, sf).select(
        "review_id", tx.snippet(F.col("review"), DEFAULTS.snippet_chars).alias("snippet"))


@query
def sentiment_two_way(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "rating", two_way(F.col("rating"), DEFAULTS).alias("sentiment"))


@query
def sentiment_three_way(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "rating", three_way(F.col("rating"), DEFAULTS).alias("sentiment"))


@query
def exclude_sources(spark, sf):
    rows = fx.reviews(spark, sf).filter(~is_excluded(F.col("source"), DEFAULTS))
    return rows.select("review_id", "source", "rating")


@query
def exclude_sources_anti(spark, sf):
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, DEFAULTS.excluded_sources))).alias("source"))
    return metrics.without_sources(fx.reviews(spark, sf), listed).select("review_id", "source", "rating")


@query
def review_link(spark, sf):
    link = ratings.review_link(F.col("source"), F.col("review_id"), F.col("url"), DEFAULTS)
    return fx.reviews(spark, sf, url=True).select("review_id", link.alias("link"))


@query
def items_min_score(spark, sf):
    return _found(spark, sf).select("review_id", "score", "category", "reason")


@query
def category_valid(spark, sf):
    labelled = fx.categorised(spark, sf).unionByName(
        fx.items(spark, sf).select(F.lit("neg").alias("sentiment"), F.lit("2026-02").alias("month"),
                                   "review_id", "category"))
    return categories.category_valid(labelled)


# Joins ----------------------------------------------------------------------------------------


@query
def items_with_reviews(spark, sf):
    return it.with_reviews(fx.items(spark, sf), fx.analysed(spark, sf)).select(
        "batch_no", "pos", "review_id", "score", "category", "reason", "matched", "published", "author",
        "source", "rating", tx.snippet(F.col("review"), DEFAULTS.snippet_chars).alias("snippet"), "url")


@query
def last_two_months(spark, sf):
    return months.in_recent_months(fx.strict_text(spark, sf), DEFAULTS.recent_months).select(
        "review_id", "month", "rating")


@query
def assign_group(spark, sf):
    return it.assign_group(fx.items(spark, sf)).select("review_id", "category", "group_ord", "group_name", "emoji")


@query
def category_grid(spark, sf):
    return categories.category_grid(categories.category_counts(fx.categorised(spark, sf)))


# Aggregations ---------------------------------------------------------------------------------


@query
def export_stats(spark, sf):
    return metrics.export_stats(fx.reviews(spark, sf)).select(
        "total", "analysed", round_exact("avg_rating", 2).alias("avg_rating"),
        day(F.col("first_ts"), "N/A").alias("first_day"), day(F.col("last_ts"), "N/A").alias("last_day"))


@query
def platform_stats(spark, sf):
    return metrics.platform_stats(fx.reviews(spark, sf)).orderBy("source")


@query
def latest_sentiment(spark, sf):
    return metrics.latest_sentiment(fx.strict_rated(spark, sf))


@query
def monthly_avg_rating(spark, sf):
    return metrics.monthly_metrics(fx.strict_rated(spark, sf)).select("month", "avg_rating").orderBy("month")


@query
def monthly_pos_neg(spark, sf):
    return metrics.monthly_metrics(fx.strict_rated(spark, sf)).select("month", "pos", "neg").orderBy("month")


@query
def source_breakdown(spark, sf):
    return metrics.source_breakdown(fx.strict_rated(spark, sf)).orderBy("source", "month")


@query
def category_counts(spark, sf):
    return categories.category_counts(fx.categorised(spark, sf))


@query
def bucket_reviews(spark, sf):
    return batching.bucket_reviews(fx.strict_text(spark, sf))


@query
def bucket_counts(spark, sf):
    return batching.bucket_counts(batching.bucket_reviews(fx.strict_text(spark, sf)))


@query
def group_summary(spark, sf):
    return it.group_summary(_found(spark, sf)).orderBy("group_ord")


@query
def group_share(spark, sf):
    return it.group_share(_found(spark, sf), metrics.review_cube(fx.reviews(spark, sf))).orderBy("group_ord")


@query
def theme_counts(spark, sf):
    return decode.theme_counts(fx.analysis_responses(spark, sf))


def _category_responses(spark, sf):
    fragments = documents.categorised_document(scoring.categorised_batches(fx.categorised(spark, sf)))
    months_json = F.get_json_object("document", "$.pos"), F.get_json_object("document", "$.neg")
    return fragments.select("sentiment", "batch_no",
                            fx.fenced(F.coalesce(*months_json), F.col("batch_no")).alias("response"))


@query
def merge_responses(spark, sf):
    return decode.merge_responses(_category_responses(spark, sf))


@query
def unanswered(spark, sf):
    answers = _category_responses(spark, sf).filter("batch_no % 2 = 0")
    return decode.unanswered(batching.bucket_reviews(fx.strict_text(spark, sf)), decode.merge_responses(answers))


@query
def distinct_months(spark, sf):
    return months.distinct_months(fx.strict_rated(spark, sf)).orderBy("month")


# Windows, sorts, sets -------------------------------------------------------------------------


@query
def batch_assign(spark, sf):
    return batching.sentiment_batches(batching.bucket_reviews(fx.strict_text(spark, sf))).select(
        "sentiment", "month", "review_id", "row_no", "batch_no", "total_batches")


@query
def batch_assign_in_order(spark, sf):
    """Batches in the order of an export of many files; the rows are written in the order of their ids."""
    path = scratch_path(spark, "export")
    write_export(fx.strict_raw(spark, sf).repartitionByRange(7, "review_id").sortWithinPartitions("review_id"), path)
    buckets = batching.bucket_reviews(rated_text(read_export(spark, path, positions=True)))
    return batching.sentiment_batches(buckets).select("sentiment", "month", "review_id", "row_no", "batch_no", "total_batches")


@query
def item_ordinals(spark, sf):
    return it.item_ordinals(fx.items(spark, sf)).select("review_id", "group_name", "score", "item_no", "group_item_no")


@query
def top_item_per_group(spark, sf):
    return it.top_item_per_group(fx.items(spark, sf)).select("group_name", "review_id", "score", "batch_no", "pos")


@query
def pick_category(spark, sf):
    return categories.pick_category(fx.candidates(spark, sf))


@query
def top_candidates(spark, sf):
    return categories.top_candidates(fx.candidates(spark, sf))


@query
def items_ranked(spark, sf):
    return it.ranked(_found(spark, sf)).select("item_no", "review_id", "score", "category", "reason")


@query
def category_union(spark, sf):
    return categories.category_union(fx.categorised(spark, sf))


# Scalar functions -----------------------------------------------------------------------------


@query
def fn_strip(spark, sf):
    padded = F.concat(F.lit(" \t  "), F.coalesce("review", F.lit("")), F.lit("　\n\x1f"))
    return fx.reviews(spark, sf).select("review_id", tx.strip(padded).alias("stripped"))


@query
def fn_stars(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "rating", tx.stars(F.col("rating")).alias("stars"))


@query
def fn_score_bar(spark, sf):
    return fx.items(spark, sf).select("review_id", "score", tx.score_bar(F.col("score")).alias("bar"))


@query
def fn_title_case(spark, sf):
    return fx.reviews(spark, sf).select("review_id", tx.title_case(F.col("review")).alias("label"))


@query
def fn_wrap_label(spark, sf):
    return fx.reviews(spark, sf).select("review_id", tx.wrap_label(F.col("review")).alias("label"))


@query
def fn_month_label(spark, sf):
    return fx.reviews(spark, sf).select(
        "review_id", month_label(F.col("month")).alias("label"), month_label_short(F.col("month")).alias("short"))


@query
def fn_base_name(spark, sf):
    return fx.reviews(spark, sf, url=True).select("review_id", tx.base_name(F.col("url")).alias("name"))


def _ratios(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").alias("part"), (1 + F.col("doc_id") % 97).alias("total"))


@query
def fn_round2(spark, sf):
    ratio = "part / total"
    return _ratios(spark, sf).select("doc_id", round_exact(ratio, 2).alias("two"), round_exact(ratio, 1).alias("one"),
                                     percent("part", "total").alias("pct"))


@query
def fn_format(spark, sf):
    ratio = "part / total"
    return _ratios(spark, sf).select("doc_id", fixed(ratio, 2, "nan").alias("two"), fixed(ratio, 1, "nan").alias("one"),
                                     tx.plural(F.col("total")).alias("suffix"))


@query
def fn_fenced_json(spark, sf):
    """Whole texts as payload in the five shapes an answer may have."""
    doc, body = F.col("doc_id"), F.col("text")
    answer = (F.when(doc % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .when(doc % 5 == 1, F.concat(F.lit("Here:\n```\n"), body, F.lit("\n```\nDone.")))
              .when(doc % 5 == 2, F.concat(F.lit("Sure. ```json "), body, F.lit("``` or\n```json\n{}\n```")))
              .when(doc % 5 == 3, F.concat(F.lit("```"), body)).otherwise(body))
    return fx.table(spark, sf, "documents").select("doc_id", tx.fenced_json(answer).alias("payload"))


@query
def fn_review_date(spark, sf):
    """Dates in several notations; one of them cannot be read."""
    doc, date = F.col("doc_id"), F.col("published")
    year, month_no, day_no = F.substring(date, 1, 4), F.substring(date, 6, 2), F.substring(date, 9, 2)
    written = (F.when(doc % 5 == 0, date).when(doc % 5 == 1, F.concat(date, F.lit(" 10:20:30")))
               .when(doc % 5 == 2, F.concat(date, F.lit("T10:20:30")))
               .when(doc % 5 == 3, F.concat_ws("/", month_no, day_no, year)).otherwise(F.concat(F.lit("on "), date)))
    dated = fx.reviews(spark, sf).withColumn("doc_id", F.substring("review_id", 2, 20).cast("long"))
    return dated.select("review_id", day(review_timestamp(written), "N/A").alias("day"))


# Responder and rule scorers -------------------------------------------------------------------


@query
def analysis_prompts(spark, sf):
    return prompts.analysis_prompts(fx.analysed(spark, sf, url=False))


@query
def categorize_prompts(spark, sf):
    return prompts.categorise_prompts(batching.bucket_reviews(fx.strict_text(spark, sf)))


@query
def categorize_reviews(spark, sf):
    return fx.categorised(spark, sf)


@query
def decode_analysis(spark, sf):
    return decode.decode_analysis(fx.analysis_responses(spark, sf))


@query
def decode_categories(spark, sf):
    return decode.decode_categories(_category_responses(spark, sf))


@query
def score_actionability(spark, sf):
    return scoring.score_actionability(fx.analysed(spark, sf, author=False, url=False), fx.ACTIONABLE_TERMS)


@query
def score_categories(spark, sf):
    return scoring.score_categories(fx.strict_text(spark, sf), fx.TERMS)


# Report, messages, charts ---------------------------------------------------------------------


@query
def platform_lines(spark, sf):
    cube = metrics.review_cube(fx.reviews(spark, sf))
    plain, chat = (report.platform_lines(cube, chat=chat) for chat in (False, True))
    return plain.select("source", "line", F.lit("report").alias("kind")).unionByName(
        chat.select("source", "line", F.lit("chat").alias("kind")))


@query
def main_blocks(spark, sf):
    responses = fx.analysis_responses(spark, sf)
    cube, summary = _cube(spark, sf), messages.main_summary(decode.theme_counts(responses))
    main = messages.main_blocks(cube, _found(spark, sf), summary, fx.EXPORT_NAME, fx.RUN_TIME)
    return main.selectExpr("0L as block_no", "blocks_json").unionByName(messages.platform_blocks(cube).select(
        "block_no", messages.section_json("text").alias("blocks_json")))


@query
def category_headers(spark, sf):
    tops = it.with_reviews(it.top_item_per_group(_found(spark, sf)), fx.analysed(spark, sf, url=False))
    return messages.category_headers(metrics.review_cube(fx.reviews(spark, sf)), _found(spark, sf), tops)


@query
def item_blocks(spark, sf):
    return messages.item_blocks(_reported(spark, sf))


@query
def chart_monthly(spark, sf):
    return charts.chart_monthly(fx.strict_rated(spark, sf)).orderBy("month")


@query
def chart_two_sources(spark, sf):
    return charts.chart_two_sources(fx.strict_rated(spark, sf)).orderBy("month")


@query
def chart_mom_positive(spark, sf):
    return charts.chart_categories(categories.category_counts(fx.categorised(spark, sf)), "pos").orderBy("category")


@query
def chart_mom_negative(spark, sf):
    return charts.chart_categories(categories.category_counts(fx.categorised(spark, sf)), "neg").orderBy("category")
