"""Rule scorers: what the responder decides from prose, decided here by terms found in the text.

A lexicon is a sequence of ``(label, term, weight)``. It becomes part of the expression, one
substring test per term inside generated code: no join, no rows per term, nothing to broadcast.
The results have the shape of decoded responses; they are not meant to equal a model's judgement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.config import DEFAULTS, Settings
from plaudit.functions.ratings import rated_side
from plaudit.functions.sql import quoted
from plaudit.operators.batching import assign_batches, sentiment_batches
from plaudit.operators.categories import picked
from plaudit.operators.months import in_recent_months

Lexicon = Sequence[tuple[str, str, float]]

# A starting point for actionable labels and categories; hand in your own for real use.
ACTIONABLE_LEXICON: Lexicon = (
    ("Login/Auth Issue", "log in", 1), ("Login/Auth Issue", "login", 1),
    ("Verification Code Failure", "verification code", 2),
    ("Payment Error", "payment failed", 1), ("Payment Error", "payment error", 1),
    ("Account Access", "locked out", 1), ("Account Access", "access my account", 1),
    ("App Crash", "crash", 1), ("App Crash", "freezes", 1),
    ("Order/Shipping Issue", "wrong item", 1), ("Slow Shipping", "slow shipping", 1),
    ("Missing Delivery", "never arrived", 1), ("Missing Delivery", "not received", 1),
    ("Return/Refund Blocked", "refund", 1), ("Return/Refund Blocked", "return", 1),
    ("Unauthorized Charge", "unauthorized", 1), ("Credit Reporting Failure", "not reporting", 1),
    ("Direct Deposit Not Recognized", "direct deposit", 1),
    ("Defective/Counterfeit Product", "defective", 1), ("Defective/Counterfeit Product", "fake", 1),
    ("Fraudulent Account Opened", "without my consent", 1),
    ("Credit Limit Not Updating", "credit limit", 1),
    ("Gig Worker Eligibility Rejected", "gig work", 1),
    ("Subscription/Fee Dispute", "subscription", 1), ("Customer Service Issue", "customer service", 1),
)
POSITIVE_LEXICON: Lexicon = (
    ("credit card", "credit card", 1), ("credit building", "credit score", 1),
    ("direct deposit", "direct deposit", 1), ("fair prices", "price", 1),
    ("fast shipping times", "fast", 1), ("good customer service experience", "customer service", 1),
    ("good in-app experience", "app", 1), ("good overall experience", "great", 1),
    ("good products", "quality", 1),
)
NEGATIVE_LEXICON: Lexicon = (
    ("customer experience", "customer service", 1), ("functionality", "app", 1),
    ("pricing", "price", 1), ("product", "quality", 1), ("deliverability/shipping", "shipping", 1),
    ("vendor issues", "vendor", 1), ("credit card", "credit card", 1),
)


def _terms(lexicon: Lexicon, label: str) -> dict[str, float]:
    return {term.lower(): weight for name, term, weight in lexicon if name == label}


def category_scores(labels: Sequence[str], lexicon: Lexicon) -> str:
    """SQL of an array of ``(confidence, preference, category, ord)``, one per label in order.

    Confidence is the weight of the label's terms found, in percent of all its weight. The text is
    taken from the column ``lowered``, so that it is lower-cased once and not once per term.
    """
    scores = []
    for at, label in enumerate(labels):
        terms = _terms(lexicon, label)
        found = " + ".join(f"if(contains(lowered, {quoted(term)}), {float(weight)}D, 0D)"
                           for term, weight in terms.items()) or "0D"
        scores.append(f"struct(cast(({found}) * 100 / {float(sum(terms.values()) or 1)}D as int) as confidence, "
                      f"{-at} as preference, {quoted(label)} as category, {at} as ord)")
    return f"array({', '.join(scores)})"


def _sided(rows: DataFrame, settings: Settings) -> DataFrame:
    return rows.withColumns({"sentiment": rated_side(F.col("rating"), settings), "lowered": F.lower("review")})


def _side_scores(lexicons: tuple[Lexicon, Lexicon], settings: Settings) -> Column:
    """Scores of the categories of a row's sentiment."""
    positive, negative = lexicons
    return F.expr(f"case when sentiment = 'pos' then {category_scores(settings.positive_categories, positive)} "
                  f"else {category_scores(settings.negative_categories, negative)} end")


DEFAULT_LEXICONS = (POSITIVE_LEXICON, NEGATIVE_LEXICON)


def score_categories(reviews: DataFrame, lexicons: tuple[Lexicon, Lexicon] = DEFAULT_LEXICONS,
                     settings: Settings = DEFAULTS) -> DataFrame:
    """Confidence of every category of a review's sentiment, from its whole text."""
    scored = _sided(reviews, settings).select("review_id", "sentiment", F.inline(_side_scores(lexicons, settings)))
    return scored.select("review_id", "sentiment", "ord", "category", "confidence")


def categorise(rated_text: DataFrame, lexicons: tuple[Lexicon, Lexicon] = DEFAULT_LEXICONS,
               settings: Settings = DEFAULTS) -> DataFrame:
    """``(sentiment, month, review_id, category)`` of the most recent months.

    Scores and pick stay in the review's own row: nothing is shuffled.
    """
    recent = in_recent_months(rated_text, settings.recent_months)
    return (_sided(recent, settings).withColumn("best", F.array_max(_side_scores(lexicons, settings)))
            .select("sentiment", "month", "review_id", picked(F.col("best"), settings).alias("category")))


def categorised_batches(categorised: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Categorised rows with batch and row numbers, ready for the document sink."""
    return sentiment_batches(categorised, settings)


def score_actionability(reviews: DataFrame, lexicon: Lexicon = ACTIONABLE_LEXICON,
                        settings: Settings = DEFAULTS) -> DataFrame:
    """``(review_id, score, category, reason)`` of reviews that contain at least one term.

    The score is one more than the number of the best label's terms found, ``max_score`` at most;
    the terms are the reason.
    """
    hits, choices = {}, []
    for at, label in enumerate(settings.actionable_labels):
        terms = list(_terms(lexicon, label))
        if not terms:
            continue
        for term in terms:
            hits.setdefault(term, f"hit_{len(hits)}")
        found = " + ".join(f"int({hits[term]})" for term in terms)
        reason = ", ".join(f"if({hits[term]}, {quoted(term)}, null)" for term in terms)
        choices.append(f"if({found} > 0, struct(least({settings.max_score}, 1 + {found}) as score, {-at} as preference, "
                       f"{quoted(label)} as category, concat_ws(', ', {reason}) as reason), null)")
    tested = (reviews.select("review_id", F.lower("review").alias("lowered"))
              .selectExpr("review_id", *[f"contains(lowered, {quoted(term)}) as {name}" for term, name in hits.items()]))
    # One generated row per review keeps the filter from repeating the scoring below it.
    best = tested.select("review_id", F.expr(f"inline(array(array_max(array({', '.join(choices)}))))"))
    return best.filter(F.col("score").isNotNull()).select("review_id", "score", "category", "reason")


def listed_items(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Scored items with ``batch_no`` and ``pos``, as if they had come in answers of a batch each."""
    batches = assign_batches(scored, [], [], settings.batch_size)
    return batches.select("batch_no", (F.pmod(F.col("row_no") - 1, F.lit(settings.batch_size))).cast("int").alias("pos"),
                          "review_id", "score", "category", "reason")
