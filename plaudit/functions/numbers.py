"""Rounding that agrees with half-even rounding of the exact binary value, and guarded ratios.

Values are SQL expressions over the columns of a row, for instance ``"mean"`` or ``"pos / total"``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLITTER = "134217729D"  # 2**27 + 1, splits a double into two halves whose products are exact


def rounded_sql(value: str, digits: int) -> str:
    """Round to ``digits`` decimals, half even on the exact value of the double.

    Spark rounds the shortest decimal text of a double, so 2.675 (stored a little lower) becomes
    2.68. Here the rounding error of ``value * 10**digits`` is computed exactly and decides the
    cases next to a tie.
    """
    x = f"abs(double({value}))"
    scale = f"{2 * 10**digits}D"  # twice the unit: a tie is an odd whole number
    high = f"({_SPLITTER} * {x} - ({_SPLITTER} * {x} - {x}))"
    product = f"({x} * {scale})"
    whole = f"rint({product})"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    beyond = f"(({product} - {whole}) + {error})"
    near_tie = f"{whole} % 2 = 1 and abs({beyond}) < 1e-6D"
    magnitude = (f"case when {near_tie} and {beyond} > 0 then ({whole} + 1) / {scale} "
                 f"when {near_tie} and {beyond} < 0 then ({whole} - 1) / {scale} "
                 f"else bround({x}, {digits}) end")
    return f"(case when {value} < 0 then -1D else 1D end * {magnitude})"


def round_exact(value: str, digits: int) -> Column:
    return F.expr(rounded_sql(value, digits))


def decimals(value: str, digits: int) -> Column:
    """Text with exactly ``digits`` decimals; null for null."""
    return F.expr(f"case when ({value}) is not null then "
                  f"format_string('%.{digits}f', {rounded_sql(value, digits)}) end")


def fixed(value: str, digits: int, missing: str) -> Column:
    """Like ``decimals``, with a text for null."""
    return text_or(decimals(value, digits), missing)


def exact(value: Column) -> Column:
    """A rating as a decimal of nine places, whose sums are exact; what such a decimal cannot hold is no rating."""
    return value.try_cast("decimal(18,9)")


def exact_mean(value: Column) -> Column:
    """Mean of ratings that does not depend on the order or the layout of rows; null ratings are left out."""
    return F.try_divide(F.sum(exact(value)).cast("double"), F.count(exact(value)))


def text_or(value: Column, missing: str) -> Column:
    return F.coalesce(value, F.lit(missing))


def percent(part: str, total: str) -> Column:
    """Whole percent, half even; 0 when the total is 0."""
    return F.expr(f"cast(coalesce(bround(try_divide({part}, {total}) * 100), 0D) as int)")


def fraction(part: str, total: str) -> Column:
    """Two-decimal fraction; null when the total is 0."""
    return round_exact(f"try_divide({part}, {total})", 2)
