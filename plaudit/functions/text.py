"""Text expressions: column in, column out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Everything that counts as white space at the ends of a text (Unicode spaces and separators).
WHITESPACE = "".join(
    chr(code)
    for code in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(text: Column) -> Column:
    """Without white space at both ends; looks at the ends only, not at the whole text."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty or white space only; stops at the first other character."""
    return F.coalesce(F.ltrim(text, F.lit(WHITESPACE)) == "", F.lit(True))


def prefix(text: Column, length: int) -> Column:
    """First ``length`` characters (code points)."""
    return F.left(text, F.lit(length))


def snippet(text: Column, length: int) -> Column:
    """First ``length`` characters, with dots when there are more. One character beyond is enough input."""
    return F.when(F.length(text) > length, F.concat(prefix(text, length), F.lit("..."))).otherwise(text)


def bar(filled: Column, full: str, empty: str, width: int = 5) -> Column:
    """``filled`` marks out of ``width``; values outside the range give no negative part."""
    return F.concat(F.repeat(F.lit(full), filled), F.repeat(F.lit(empty), F.lit(width) - filled))


def stars(rating: Column) -> Column:
    """Whole stars of a rating; the fraction is cut off."""
    return bar(rating.cast("int"), "★", "☆")


def score_bar(score: Column) -> Column:
    return bar(score.cast("int"), "█", "░")


def title_case(text: Column) -> Column:
    """Upper case for each letter that follows a non-letter, lower case for the other letters."""
    runs = F.split(F.lower(text), r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(runs, F.initcap), "")


def wrap_label(text: Column, width: int = 14) -> Column:
    """Title-cased label, broken greedily between words into lines of at most ``width`` characters.

    A line is the longest run of words that fits, or one longer word; one pass over the label.
    """
    label = title_case(text)
    words = F.regexp_replace(strip(label), f"[{WHITESPACE}]+", " ")
    lines = F.regexp_replace(words, rf"(\S{{{width + 1},}}|.{{1,{width}}})( |$)", "$1\n")
    return F.when(F.length(label) > width, F.rtrim(lines, F.lit("\n"))).otherwise(label)


def plural(count: Column) -> Column:
    return F.when(count != 1, "s").otherwise("")


def base_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def fenced_json(answer: Column) -> Column:
    """The JSON part of an answer: inside a ``json`` fence, else inside a plain fence, else all of it."""
    fence = "```"

    def inside(mark: str) -> Column:
        return strip(F.substring_index(F.get(F.split(answer, mark, 3), F.lit(1)), fence, 1))

    return (F.when(F.contains(answer, F.lit(fence + "json")), inside(fence + "json"))
            .when(F.contains(answer, F.lit(fence)), inside(fence))
            .otherwise(answer))
