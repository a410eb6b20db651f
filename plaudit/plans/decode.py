"""Decoding of responses. What cannot be parsed goes to a reject table instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.text import fenced_json

# Leaves are text: a value of another type then costs its own element, not the answer around it.
ANALYSIS = "summary string, theme_counts string, actionable_items string, malformed string"
ITEM = "review_id string, actionability_score string, category string, reason string"
TEXTS, TEXT_MAP = "array<string>", "map<string,string>"


def parse_analysis(responses: DataFrame) -> DataFrame:
    """``(batch_no, response, answer)`` of ``(batch_no, response)``; parsed answers pass as they are."""
    if "answer" in responses.columns:
        return responses
    answer = F.from_json(fenced_json(F.col("response")), ANALYSIS,
                         {"columnNameOfCorruptRecord": "malformed"})
    return responses.select("batch_no", "response", answer.alias("answer"))


def is_parsed() -> Column:
    return F.col("answer").isNotNull() & F.col("answer.malformed").isNull()


def whole_number(text: Column) -> Column:
    """The whole number a text stands for, else null: ``5``, ``5.0``, but not ``4.5`` or ``five``."""
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def _listed(responses: DataFrame) -> DataFrame:
    """All items with their score as text; ``item`` is null where an entry is not an object."""
    listed = parse_analysis(responses).filter(is_parsed()).select(
        "batch_no", F.posexplode(F.from_json("answer.actionable_items", TEXTS)).alias("pos", "entry"))
    item = F.when(F.ltrim("entry").startswith("{"), F.from_json("entry", ITEM))
    return listed.select("batch_no", "pos", "entry", item.alias("item")).withColumn(
        "score", whole_number(F.col("item.actionability_score")))


def _usable() -> Column:
    return F.col("item").isNotNull() & (F.col("item.actionability_score").isNull() | F.col("score").isNotNull())


def decode_analysis(responses: DataFrame) -> DataFrame:
    """Items of all responses, in the form of ``plaudit.operators.items``."""
    return _listed(responses).filter(_usable()).select(
        "batch_no", "pos", "item.review_id", "score", "item.category", "item.reason")


def rejected_entries(responses: DataFrame) -> DataFrame:
    """``(batch_no, pos, entry)``: entries that are no items, or whose score is no whole number."""
    return _listed(responses).filter(~_usable()).select("batch_no", "pos", "entry")


def theme_counts(responses: DataFrame) -> DataFrame:
    """Reviews per theme, summed over all responses; counts that are not whole numbers are left out."""
    themes = parse_analysis(responses).filter(is_parsed()).select(
        F.explode(F.from_json("answer.theme_counts", TEXT_MAP)).alias("theme", "text"))
    counted = themes.withColumn("n", whole_number(F.col("text"))).filter(F.col("n").isNotNull())
    return counted.groupBy("theme").agg(F.sum("n").alias("n"))


def summaries(responses: DataFrame) -> DataFrame:
    """``(batch_no, summary)``."""
    return parse_analysis(responses).filter(is_parsed()).select(
        "batch_no", F.coalesce("answer.summary", F.lit("")).alias("summary"))


def rejected_responses(responses: DataFrame) -> DataFrame:
    return parse_analysis(responses).filter(~is_parsed()).select("batch_no", "response")


def themes_sentence(themes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: a sentence with the most frequent themes, or that there is none, for reports without a model's summary."""
    top = themes.orderBy(F.desc("n"), "theme").limit(settings.top_themes)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "theme", "n")))
    shown = F.transform(listed, lambda row: F.concat(row["theme"], F.lit(" ("), row["n"].cast("string"), F.lit(")")))
    return top.agg(F.when(F.count("*") == 0, "No themes were found.").otherwise(
        F.concat(F.lit("Most frequent themes: "), F.array_join(shown, ", "), F.lit("."))).alias("summary"))


def _entries(responses: DataFrame) -> DataFrame:
    """One row per entry of a month; a month that is no list is a single entry of its own text."""
    months = F.from_json(fenced_json(F.col("response")), TEXT_MAP)
    rows = responses.select("sentiment", "batch_no", F.explode(months).alias("month", "text"))
    entries = F.coalesce(F.when(F.ltrim("text").startswith("["), F.from_json("text", TEXTS)), F.array("text"))
    return rows.select("sentiment", "batch_no", "month", F.posexplode(entries).alias("item_no", "entry")).withColumn(
        "row", F.when(F.ltrim("entry").startswith("{"), F.from_json("entry", "review_id string, category string")))


def decode_categories(responses: DataFrame) -> DataFrame:
    """``(sentiment, batch_no, month, item_no, review_id, category)`` of ``(sentiment, batch_no, response)``."""
    return (_entries(responses).filter(F.col("row").isNotNull())
            .select("sentiment", "batch_no", "month", "item_no", "row.review_id", "row.category"))


def rejected_category_entries(responses: DataFrame) -> DataFrame:
    """``(sentiment, batch_no, month, entry)``: entries that are no objects."""
    return _entries(responses).filter(F.col("row").isNull()).select("sentiment", "batch_no", "month", "entry")


def rejected_categories(responses: DataFrame) -> DataFrame:
    """Answers that are no object at all."""
    months = F.from_json(fenced_json(F.col("response")), TEXT_MAP)
    return responses.filter(months.isNull()).select("sentiment", "batch_no", "response")


def merge_responses(responses: DataFrame) -> DataFrame:
    """All batches as one table ``(sentiment, month, review_id, category)``; rows just add up."""
    return decode_categories(responses).select("sentiment", "month", "review_id", "category")


def unanswered(asked: DataFrame, categorised: DataFrame) -> DataFrame:
    """Reviews that no response gave a category."""
    keys = ["sentiment", "month", "review_id"]
    return asked.join(categorised.select(*keys), keys, "left_anti")
