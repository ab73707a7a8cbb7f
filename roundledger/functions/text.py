"""Numbers, metrics and outcomes as report text; text as numbers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric names and their labels, in display order.
METRIC_LABELS = {
    "totalTips": "Total Tips",
    "accuracy": "Accuracy",
    "mae": "MAE",
    "bits": "Bits",
}
METRICS = tuple(METRIC_LABELS)

# Words for a missing number and for a pick's outcome.
MISSING = "NA"
CORRECT, WRONG, UNKNOWN = "yeah", "nah", "dunno"

# Multiplying by this splits a double into halves of at most 26 bits each.
_SPLITTER = float(2**27 + 1)
MOST_DIGITS = 15
_WHOLE_FROM = float(2**53)  # doubles from here on have no fraction
_LONG_BELOW = float(2**63)


def _halves(number: float) -> tuple[float, float]:
    high = number * _SPLITTER - (number * _SPLITTER - number)
    return high, number - high


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once.

    Written out wherever it is used, the formatting grows to methods of 50,000
    bytes, which Java does not compile.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _rounded_fraction(fraction: Column, digits: int) -> Column:
    """``fraction * 10**digits`` rounded half up on the exact product.

    The product is below 10**15, so its own fraction is a multiple of an
    eighth or finer, and only where it comes out as exactly a half does the
    rounding error of the product decide.
    """
    scale = float(10**digits)
    scale_high, scale_low = _halves(scale)

    def rounded(parts: Column) -> Column:
        product, high, low = parts["product"], parts["high"], parts["low"]
        rest = product - F.floor(product)
        error = (
            (high * scale_high - product) + high * scale_low + low * scale_high
        ) + low * scale_low
        up = (rest > 0.5) | ((rest == 0.5) & (error >= 0))
        return F.floor(product) + up.cast("bigint")

    high = fraction * _SPLITTER - (fraction * _SPLITTER - fraction)
    parts = F.struct(
        (fraction * scale).alias("product"), high.alias("high"), (fraction - high).alias("low")
    )
    return _let(parts, rounded)


def _small_text(size: Column, digits: int) -> Column:
    """Text of a size below 2**53."""

    def joined(parts: Column) -> Column:
        carry = (parts["scaled"] >= 10**digits).cast("bigint")
        text = (parts["whole"] + carry).cast("string")
        if digits:
            kept = (parts["scaled"] - carry * 10**digits).cast("string")
            text = F.concat(text, F.lit("."), F.lpad(kept, digits, "0"))
        return text

    whole = F.floor(size)
    scaled = _let(size - whole, lambda fraction: _rounded_fraction(fraction, digits))
    return _let(F.struct(whole.alias("whole"), scaled.alias("scaled")), joined)


def _large_text(size: Column, digits: int) -> Column:
    """Text of a size from 2**53 on, which has no fraction."""
    # Beyond long a double is a multiple of 1024.
    whole = F.when(size < _LONG_BELOW, size.try_cast("bigint").cast("decimal(38,0)")).otherwise(
        (size / 1024).try_cast("bigint").cast("decimal(28,0)") * F.lit(1024)
    )
    fixed = F.concat(whole.cast("string"), F.lit("." + "0" * digits if digits else ""))
    # From 1e21 on even fixed-point text uses an exponent: 1e+21.
    exponent = F.regexp_replace(F.regexp_replace(size.cast("string"), r"\.0E", "E"), "E", "e+")
    return F.when(size >= 1e21, exponent).otherwise(fixed)


def fixed_point(value: Column, digits: int = 0) -> Column:
    """``value`` with a fixed number of decimals, rounded on its exact value.

    True ties go away from zero. The whole part is taken off first, which is
    exact, so only the fraction is scaled and no magnitude is beyond reach.
    Up to 15 digits; more are refused.
    """
    if not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"digits must be 0 to {MOST_DIGITS}: {digits}")

    def shown(number: Column) -> Column:
        size = F.abs(number)
        text = (
            F.when(F.isnan(number), F.lit("NaN"))
            .when(size < _WHOLE_FROM, _small_text(size, digits))
            .otherwise(_large_text(size, digits))
        )
        return F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), text)

    return _let(value.cast("double"), shown)


def present_number(value: Column, digits: int = 0) -> Column:
    return F.when(value.isNull(), MISSING).otherwise(fixed_point(value, digits))


def present_percentage(value: Column, digits: int = 2) -> Column:
    """A fraction as a percentage."""
    percent = fixed_point(value.cast("double") * 100, digits)
    return F.when(value.isNull(), MISSING).otherwise(F.concat(percent, F.lit("%")))


def present_metric(metric: Column, value: Column, digits: int) -> Column:
    """A metric's value in its own format; tip counts never show decimals.

    Charts use 0 digits on the axis and 2 in the tooltip.
    """
    is_fraction = metric == "accuracy"
    text = fixed_point(F.when(is_fraction, value * 100).otherwise(value), digits)
    if digits > 0:
        text = F.when(metric == "totalTips", fixed_point(value)).otherwise(text)
    text = F.concat(text, F.when(is_fraction, "%").otherwise(""))
    return F.when(is_metric(metric), F.when(value.isNull(), MISSING).otherwise(text))


def metric_label(metric: Column) -> Column:
    pairs = [F.lit(part) for pair in METRIC_LABELS.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), metric)


def is_metric(metric: Column) -> Column:
    return metric.isin(*METRICS)


def correctness(is_correct: Column) -> Column:
    return F.when(is_correct, CORRECT).when(~is_correct, WRONG).otherwise(UNKNOWN)


def finite(value: Column) -> Column:
    """``value`` for JSON, which has no infinities: NULL stands for them."""
    size = F.abs(value)
    return F.when(size < float("inf"), value)


# What counts as blank before a number.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Fixed pattern: the whole number a text starts with, decimal or hexadecimal.
_INTEGER_PREFIX = rf"^[{BLANKS}]*([+-]?)(?:0[xX]([0-9a-fA-F]*)|([0-9]+))"


def integer_prefix(text: Column) -> Column:
    """The whole number ``text`` starts with; NULL without digits or beyond 64 bits.

    Digits after ``0x`` are hexadecimal; ``0x`` without any is no number.
    """
    sign, hexadecimal, decimal = (F.regexp_extract(text, _INTEGER_PREFIX, i) for i in (1, 2, 3))
    short = F.regexp_replace(hexadecimal, "^0+(?=.)", "")
    number = (
        F.when(decimal != "", F.concat(sign, decimal))
        .when(F.length(short).between(1, 16), F.concat(sign, F.conv(short, 16, 10)))
    )
    return number.try_cast("bigint")


def parse_integer_prefix(text: str | None) -> int | None:
    """``integer_prefix`` for a request parameter."""
    found = re.match(_INTEGER_PREFIX, text or "")
    if found is None:
        return None
    sign, hexadecimal, decimal = found.groups()
    digits = (decimal or hexadecimal or "").lstrip("0") or (decimal or hexadecimal or "")[:1]
    if not digits or len(digits) > 20:
        return None
    number = int(sign + digits, 10 if decimal else 16)
    return number if -(2**63) <= number < 2**63 else None


def year_start(year: Column) -> Column:
    """First instant of a year, UTC."""
    one, zero = F.lit(1), F.lit(0)
    return F.make_timestamp(year, one, one, zero, zero, zero, F.lit("UTC"))


def within_year(moment: Column, year: int) -> Column:
    """Half-open range on the bare column, so file readers can skip on it."""
    return (moment >= F.lit(f"{year:04d}-01-01T00:00:00Z").cast("timestamp")) & (
        moment < F.lit(f"{year + 1:04d}-01-01T00:00:00Z").cast("timestamp")
    )
