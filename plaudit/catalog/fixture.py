"""Review-shaped inputs derived by Spark from the given tables, each row from one document.

There is no review table among them, so ids, dates, sources and ratings are computed from
``documents``; authors and links come from ``customer`` and ``pages`` and are joined only where a
query needs them. Whole tables and whole texts throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.operators.scoring import Lexicon, categorise, score_actionability, score_categories
from plaudit.sources.exports import analysable, coerced, rated, rated_text

# Terms for the rule scorers: pieces of the words in the invented prose.
POSITIVE_TERMS: Lexicon = (
    ("credit card", "eaux", 1), ("credit card", "queque", 2),
    ("credit building", "ción", 3), ("credit building", "ado", 1),
    ("direct deposit", "heit", 1), ("direct deposit", "ß", 1),
    ("fair prices", "that", 2), ("fair prices", "with", 1), ("fair prices", "of", 2),
    ("fast shipping times", "sch", 3), ("fast shipping times", "ung", 1),
    ("good customer service experience", "nter", 1), ("good customer service experience", "has", 1),
    ("good in-app experience", "los", 1),
    ("good overall experience", "erst", 1), ("good overall experience", "tion", 2), ("good overall experience", "xyzzy", 1),
    ("good products", "ouv", 1), ("good products", "ment", 3),
)
NEGATIVE_TERMS: Lexicon = (
    ("customer experience", "was", 1), ("customer experience", "ing", 1),
    ("functionality", "heit", 2), ("functionality", "ich", 1),
    ("pricing", "ción", 1), ("product", "ouè", 1), ("product", "eau", 3),
    ("deliverability/shipping", "sch", 1), ("deliverability/shipping", "the", 1), ("deliverability/shipping", "and", 1),
    ("vendor issues", "###", 1), ("credit card", "$$$", 2), ("credit card", "ent", 1),
)
TERMS = (POSITIVE_TERMS, NEGATIVE_TERMS)
ACTIONABLE_TERMS: Lexicon = tuple(
    (label, term, 1.0) for label, terms in (
        ("Login/Auth Issue", ("login", "queque")), ("Verification Code Failure", ("ción", "ado", "los")),
        ("Payment Error", ("ouv",)), ("App Crash", ("###", "&&&", "%%%", "***", "$$$")),
        ("Slow Shipping", ("sch", "ung")), ("Missing Delivery", ("eaux", "ment", "ouè")),
        ("Unauthorized Charge", ("token",)), ("Fraudulent Account Opened", ("@",)),
        ("Subscription/Fee Dispute", ("thand", "ingth")), ("Customer Service Issue", ("ß", "heit", "ich", "erst")),
    ) for term in terms)

RUN_TIME = "2026-03-04 14:32"
EXPORT_NAME = "export-2026-03-04.csv"
BATCH = 150


# Columns used of the given tables; with a schema no job has to look for it.
SCHEMAS = {
    "documents": "doc_id bigint, text string, source string, n_chars bigint",
    "customer": "c_custkey bigint, c_name string",
    "pages": "page_id bigint, url string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


DIGITS = "lpad(string(doc_id), 8, '0')"


def raw_reviews(spark: SparkSession, sf_dir: str, author: bool = True, url: bool = True) -> DataFrame:
    """The raw export, all columns as text: a review per document, and a blank one more for every 37th."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "*", "explode(if(doc_id % 37 = 0, array(false, true), array(false))) as blank").selectExpr(
        "doc_id", f"concat(if(blank, 'B', 'R'), {DIGITS}) as review_id",
        "date_format(date_sub(date'2026-02-18', int(doc_id * 13 % 365)), 'yyyy-MM-dd') as published",
        """case int(substr(source, 4)) % 5 when 0 then 'Google Play' when 1 then 'iOS App Store' when 2 then 'BBB'
            when 3 then 'CreditKarma' else if(doc_id % 43 = 0, null, 'Trustpilot') end as source""",
        """case when doc_id % 23 = 0 then null when doc_id % 41 = 0 then 'N/A' when doc_id % 29 = 0 then '3.5'
            else concat(string(1 + (doc_id * 7 + n_chars) % 5), '.0') end as rating_raw""",
        "if(doc_id % 31 = 0, null, substring_index(text, '\n', 1)) as title",
        "if(blank, '  ', text) as review",
    )
    rows = _looked_up(rows, spark, sf_dir, ("customer", "c_custkey", "c_name"), "author", author)
    rows = _looked_up(rows, spark, sf_dir, ("pages", "page_id", "url"), "url", url)
    return rows.select("review_id", "published", "author", "source", "rating_raw", "title", "review", "url")


def _looked_up(rows: DataFrame, spark: SparkSession, sf_dir: str, place: tuple[str, str, str], name: str,
               wanted: bool) -> DataFrame:
    """Add a column of another table, spread over all its rows; null when nobody needs it."""
    if not wanted:
        return rows.withColumn(name, F.lit(None).cast("string"))
    source, key, value = place
    other = table(spark, sf_dir, source)
    size = other.agg(F.count("*")).scalar()
    return (rows.withColumn("at", F.col("doc_id") % size)
            .join(other.selectExpr(f"{key} as at", f"{value} as {name}"), "at", "left").drop("at"))


def reviews(spark: SparkSession, sf_dir: str, author: bool = False, url: bool = False) -> DataFrame:
    return coerced(raw_reviews(spark, sf_dir, author, url))


def analysed(spark: SparkSession, sf_dir: str, author: bool = True, url: bool = True) -> DataFrame:
    return analysable(reviews(spark, sf_dir, author, url))


def strict_raw(spark: SparkSession, sf_dir: str, author: bool = False, url: bool = False) -> DataFrame:
    """Without the ratings the strict dialect refuses."""
    return raw_reviews(spark, sf_dir, author, url).withColumn(
        "rating_raw", F.nullif(F.col("rating_raw"), F.lit("N/A")))


def strict_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(strict_raw(spark, sf_dir))


def strict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated_text(strict_raw(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as the terms in the whole texts make them, in batches by id; some ids are in no export, some scores low."""
    number = "bigint(substr(review_id, 2))"
    return score_actionability(analysed(spark, sf_dir, author=False, url=False), ACTIONABLE_TERMS).selectExpr(
        f"{number} div {BATCH} + 1 as batch_no", f"int({number} % {BATCH}) as pos",
        f"if({number} % 97 = 0, concat('X', string({number})), review_id) as review_id",
        f"if({number} % 5 = 0, 1, score) as score", "category", "reason")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rated review's confidences from its whole text, for each category of its side."""
    return score_categories(strict_text(spark, sf_dir), TERMS).select("review_id", "ord", "category", "confidence")


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorise(strict_text(spark, sf_dir), TERMS)


def fenced(answer: Column, batch_no: Column) -> Column:
    """Answers in the shapes responders use: a json fence, a plain fence within prose, no fence."""
    return (F.when(batch_no % 3 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
            .when(batch_no % 3 == 1, F.concat(F.lit("Here it is:\n```\n"), answer, F.lit("\n```\nDone.")))
            .otherwise(answer))


def analysis_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(batch_no, response)``: the items of 150 documents each, wrapped as a responder would."""
    item = F.struct("pos", F.struct("review_id", F.col("score").alias("actionability_score"),
                                    "category", "reason").alias("item"))
    listed = items(spark, sf_dir).groupBy("batch_no").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    found = F.transform("rows", lambda row: row["item"])
    labels = F.array_distinct(F.transform(found, lambda entry: entry["category"]))
    themes = F.map_from_entries(F.transform(labels, lambda label: F.struct(
        label, F.size(F.filter(found, lambda entry: entry["category"] == label)))))
    # Scores as text, and an entry, a score and a count that are none: only these are rejected.
    found = F.transform(found, lambda entry: F.struct(
        entry["review_id"].alias("review_id"), entry["actionability_score"].cast("string").alias("actionability_score"),
        entry["category"].alias("category"), entry["reason"].alias("reason")))
    found = F.concat(found, F.array(F.struct(F.lit("none").alias("review_id"), F.lit("4.5").alias("actionability_score"),
                                             F.lit("none").alias("category"), F.lit("none").alias("reason"))))
    themes = F.map_concat(F.transform_values(themes, lambda _, n: n.cast("string")), F.create_map(F.lit("none"), F.lit("many")))
    summary = F.concat(F.lit("Summary of batch "), F.col("batch_no").cast("string"), F.lit("."))
    answer = F.to_json(F.struct(summary.alias("summary"), themes.alias("theme_counts"),
                                found.alias("actionable_items")))
    return listed.select("batch_no", fenced(answer, F.col("batch_no")).alias("response"))


