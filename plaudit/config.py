"""Thresholds, vocabularies and other fixed values, all overridable through ``Settings``."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values ---------------------------------------------------------------------------------

# Header of a review export and the column names used here.
EXPORT_COLUMNS = (
    ("Review ID", "review_id"),
    ("Published", "published"),
    ("Author", "author"),
    ("Source", "source"),
    ("Rating", "rating_raw"),
    ("Title", "title"),
    ("Review", "review"),
    ("URL", "url"),
)

# Tokens that the coercing reader takes for a missing value (the empty string is one too).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Display groups of actionable items: name, emoji, substrings of the category label.
# The first group with a matching substring wins; the last one takes everything else.
CATEGORY_GROUPS = (
    ("Order/Shipping", ":package:",
     ("order", "shipping", "delivery", "slow shipping", "missing delivery", "defective", "counterfeit")),
    ("Return/Refund", ":leftwards_arrow_with_hook:", ("return", "refund")),
    ("Billing/Payments", ":money_with_wings:",
     ("payment", "charge", "billing", "subscription", "fee", "direct deposit")),
    ("Credit", ":credit_card:", ("credit reporting", "credit limit")),
    ("Fraud/Identity", ":lock:", ("fraud", "identity", "fraudulent account")),
    ("Customer Service", ":headphones:", ("customer service",)),
    ("Core Issues", ":hammer_and_wrench:", ()),
)

POSITIVE_CATEGORIES = (
    "credit card", "credit building", "direct deposit", "fair prices", "fast shipping times",
    "good customer service experience", "good in-app experience", "good overall experience",
    "good products", "other",
)

NEGATIVE_CATEGORIES = (
    "customer experience", "functionality", "pricing", "product", "deliverability/shipping",
    "vendor issues", "credit card", "other",
)

ACTIONABLE_LABELS = (
    "Login/Auth Issue", "Verification Code Failure", "Payment Error", "Account Access", "App Crash",
    "Order/Shipping Issue", "Slow Shipping", "Missing Delivery", "Return/Refund Blocked",
    "Unauthorized Charge", "Credit Reporting Failure", "Direct Deposit Not Recognized",
    "Defective/Counterfeit Product", "Fraudulent Account Opened", "Credit Limit Not Updating",
    "Gig Worker Eligibility Rejected", "Subscription/Fee Dispute", "Customer Service Issue",
)

# Platforms without a link per review; also the ones left out of the monthly aggregates.
UNLINKED_SOURCES = ("BBB", "CreditKarma")
LINK_BASE = "https://app.reviewtrackers.com/reviews/"

OTHER = "other"

# ----------------------------------------------------------------------------------------------

# Formats tried in turn on the publication date.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssX", "M/d/yyyy", "M/d/yyyy H:mm",
)


@dataclass(frozen=True)
class Settings:
    rating_cutoff: float = 5.0          # analysed: rating <= cutoff
    positive_from: float = 4.0          # positive: rating >= this
    negative_upto: float = 3.0          # three-way negative: rating <= this
    prompt_chars: int = 500             # characters of a review shown to the responder
    snippet_chars: int = 200            # characters of a review shown in a report
    batch_size: int = 150               # reviews per prompt
    min_score: int = 3                  # items below are not actionable
    max_score: int = 5
    min_confidence: int = 70            # a category must be above this
    top_candidates: int = 3
    recent_months: int = 2
    top_themes: int = 5
    lines_per_block: int = 20           # platform lines in one chat block
    unlinked_sources: tuple[str, ...] = UNLINKED_SOURCES
    excluded_sources: tuple[str, ...] = UNLINKED_SOURCES
    link_base: str = LINK_BASE
    groups: tuple = CATEGORY_GROUPS
    positive_categories: tuple[str, ...] = POSITIVE_CATEGORIES
    negative_categories: tuple[str, ...] = NEGATIVE_CATEGORIES
    actionable_labels: tuple[str, ...] = ACTIONABLE_LABELS
    compared_sources: tuple = (("ios", "iOS App Store"), ("google_play", "Google Play"))
    company: str = "our company"
    report_title: str = "AI Review Analysis Report"
    missing_text: str = "nan"           # how a missing text field of a review is printed


DEFAULTS = Settings()
