import random
import sys

import pytest
from pyspark.sql import functions as F

from plaudit.config import ACTIONABLE_LABELS, DEFAULTS, NEGATIVE_CATEGORIES, POSITIVE_CATEGORIES
from plaudit.functions import dates, numbers, ratings, text
from plaudit.functions.sql import filled


def values(spark, column, inputs, kind="string"):
    frame = spark.createDataFrame([(at, value) for at, value in enumerate(inputs)], f"at int, x {kind}")
    return [row[1] for row in frame.select("at", column.alias("y")).orderBy("at").collect()]


def test_whitespace_is_what_python_strips():
    spaces = {chr(code) for code in range(sys.maxunicode + 1) if chr(code).isspace()}
    assert set(text.WHITESPACE) == spaces


def test_strip_and_blank(spark):
    inputs = ["", " ", "\u00a0\u2003", "a", " a b\n", "\x1fa\x1c", "\u3000ä\u3000 ", None, "a\u200b"]
    assert values(spark, text.strip(F.col("x")), inputs) == [None if v is None else v.strip() for v in inputs]
    assert values(spark, text.is_blank(F.col("x")), inputs) == [v is None or not v.strip() for v in inputs]


def test_rounding_agrees_with_python(spark):
    random.seed(7)
    grid = [total / 2 / count for count in range(1, 120) for total in range(count * 2, count * 10 + 1)]
    grid += [0.125, 2.675, 1.005, 107 / 40, 33 / 8, 0.0, 4.999, 1e9 + 0.125]
    grid += [random.uniform(0, 5) for _ in range(5000)] + [-x for x in grid[:3000]]
    for digits in (1, 2):
        found = values(spark, numbers.round_exact("x", digits), grid, "double")
        wrong = [(x, y) for x, y in zip(grid, found) if round(x, digits) != y]
        assert not wrong, wrong[:5]
    shown = values(spark, numbers.fixed("x", 2, "nan"), [2.675, 4.125, 3.0, None], "double")
    assert shown == ["2.67", "4.12", "3.00", "nan"]


def test_percent_is_half_even_and_guarded(spark):
    pairs = [(part, total) for total in range(0, 60) for part in range(total + 1)]
    frame = spark.createDataFrame([(at, *pair) for at, pair in enumerate(pairs)], "at int, p long, t long")
    found = [row[0] for row in frame.orderBy("at").select(numbers.percent("p", "t")).collect()]
    assert found == [round(p / t * 100) if t else 0 for p, t in pairs]
    nothing = frame.filter("t = 0").select(numbers.fraction("p", "t")).collect()
    assert nothing[0][0] is None


def wrap(label, width=14):
    """Greedy fold in plain Python."""
    label = label.title()
    if len(label) <= width:
        return label
    lines = []
    for word in label.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return "\n".join(lines)


def test_labels(spark):
    labels = [*POSITIVE_CATEGORIES, *NEGATIVE_CATEGORIES, *ACTIONABLE_LABELS, "it's 3rd-party", "élan  vital d'été",
              "a" * 30, "one two three four five six", "x  y", "exactly fourte", "ßäß"]
    assert values(spark, text.title_case(F.col("x")), labels) == [label.title() for label in labels]
    assert values(spark, text.wrap_label(F.col("x")), labels) == [wrap(label) for label in labels]
    assert wrap("good in-app experience") == "Good In-App\nExperience"


def test_stars_and_bars(spark):
    assert values(spark, text.stars(F.col("x")), [3.5, 5.0, 0.0, 7.0], "double") == ["★★★☆☆", "★★★★★", "☆☆☆☆☆", "★★★★★★★"]
    assert values(spark, text.score_bar(F.col("x")), [4, 0, 6], "int") == ["████░", "░░░░░", "██████"]


def test_snippet_and_prefix(spark):
    inputs = ["x" * 200, "x" * 201, "😀" * 201, "", None]
    expected = [v if v is None or len(v) <= 200 else v[:200] + "..." for v in inputs]
    assert values(spark, text.snippet(F.col("x"), 200), inputs) == expected
    assert values(spark, text.prefix(F.col("x"), 3), ["😀b😀d", "ab"]) == ["😀b😀", "ab"]


def test_small_texts(spark):
    assert values(spark, text.plural(F.col("x")), [0, 1, 2], "int") == ["s", "", "s"]
    assert values(spark, text.base_name(F.col("x")), ["a/b/c.csv", "c.csv"]) == ["c.csv", "c.csv"]
    assert values(spark, filled("{a}'\\{x}\n", a="it's"), ["v", None]) == ["it's'\\v\n", None]


def test_fenced_json(spark):
    answers = ['```json\n{"a":1}\n```', 'Here:\n```\n{"a":2}\n```\nBye', ' {"a":3} ', '```json {"a":4}``` x ```json {}```',
               "``` {\"a\":5}", "no json"]
    expected = ['{"a":1}', '{"a":2}', ' {"a":3} ', '{"a":4}', '{"a":5}', "no json"]
    assert values(spark, text.fenced_json(F.col("x")), answers) == expected


def test_dates(spark):
    inputs = ["2026-02-18", "2026-02-18 09:30:00", "2/18/2026", "2026-02-18T09:30:00Z", "not a date", None, "2026-13-01"]
    days = values(spark, dates.day(dates.review_timestamp(F.col("x")), "N/A"), inputs)
    assert days == ["2026-02-18"] * 4 + ["N/A"] * 3
    assert values(spark, dates.month_key(F.col("x")), inputs[:1] + inputs[4:6]) == ["2026-02", "not a d", ""]
    assert values(spark, dates.month_key(F.col("x"), validate=True), ["2026-02-18", "junk"]) == ["2026-02", None]
    assert values(spark, dates.month_label(F.col("x")), ["2026-02", "not a d"]) == ["February\n2026", "not a d"]
    assert values(spark, dates.month_label_short(F.col("x")), ["2026-02"]) == ["Feb 2026"]


RATINGS = ["5", "4.5", "5d", "5f", "abc", "nan", "inf", " 5 ", "1_0", "5", "", None, "-1", "1e0", ".5", "5."]
NUMBERS = [5, 4.5, None, None, None, None, None, 5, None, None, None, None, -1, 1, .5, 5]


def test_coerced_ratings(spark):
    inputs = [*RATINGS[:9], "\uff15", *RATINGS[10:]]
    assert values(spark, ratings.coerce_rating(F.col("x")), inputs) == NUMBERS


@pytest.mark.parametrize("bad", ["5d", "abc", "nan", "inf", "1_0", "N/A", "  "])
def test_strict_rating_fails(spark, bad):
    with pytest.raises(Exception, match="rating is not a number"):
        values(spark, ratings.strict_rating(F.col("x")), ["4", bad])
    assert values(spark, ratings.strict_rating(F.col("x")), ["4", " 5 ", None]) == [4.0, 5.0, None]


def test_sentiment(spark):
    inputs = [3.5, 3.0, 4.0, 0.0, 5.0, None]
    assert values(spark, ratings.two_way(F.col("x"), DEFAULTS), inputs, "double") == ["neg", "neg", "pos", "neg", "pos", None]
    assert values(spark, ratings.three_way(F.col("x"), DEFAULTS), inputs, "double") == [None, "neg", "pos", "neg", "pos", None]


def test_links(spark):
    frame = spark.createDataFrame([(1, "BBB", "http://x"), (2, "Google Play", "http://y"), (3, None, ""), (4, "BBB", None)],
                                  "at int, source string, url string")
    link = ratings.review_link(F.col("source"), F.concat(F.lit("R"), "at"), F.col("url"), DEFAULTS)
    found = [row[0] for row in frame.orderBy("at").select(link).collect()]
    assert found == [DEFAULTS.link_base + "R1", "http://y", None, DEFAULTS.link_base + "R4"]
