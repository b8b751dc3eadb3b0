"""Brazilian number text: parsing, guarding and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values.
MAX_MAGNITUDE = 1e12
MAX_DIGITS = 12

_PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(text: Column) -> Column:
    """Double of a plain decimal text, null for anything else (Java suffixes such as ``1d`` included)."""
    return F.when(text.rlike(_PLAIN_NUMBER), text.try_cast("double"))


def parse_ptbr(text: Column) -> Column:
    """``1.234.567,8`` as 1234567.8; text that is no number becomes null."""
    return to_number(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def guard_magnitude(number: Column, limit: float = MAX_MAGNITUDE) -> Column:
    """Null where the absolute value passes the limit."""
    return F.when(F.abs(number) <= limit, number)


def parse_ptbr_strict(text: Column, limit: float = MAX_MAGNITUDE) -> Column:
    """As ``parse_ptbr`` with blanks and no-break spaces removed and absurd magnitudes nulled."""
    return guard_magnitude(parse_ptbr(F.regexp_replace(text, r"[\u00a0 ]", "")), limit)


def ptbr_column(df: DataFrame, name: str) -> Column:
    """A numeric column as it is, a text column parsed: a number is never cleaned twice."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return nan_to_null(F.col(name).cast("double"))
    return parse_ptbr(F.col(name))


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def is_suspicious(text: Column, max_digits: int = MAX_DIGITS) -> Column:
    """Text with a letter in it or with too many digits; null counts as unsuspicious."""
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    return F.coalesce(text.rlike(r"\p{L}") | (digits > max_digits), F.lit(False))


def format_ptbr(number: Column) -> Column:
    """Decimal-comma text of a double that reads back to the same double.

    Doubles print in scientific form from 1e7 up and below 1e-3; there the digits are moved to their places.
    """
    number = number.cast("double")
    text = number.cast("string")
    # Cheap text functions only: the generated code of a row with many numbers must stay small.
    parts = F.split(text, "E")
    sign = F.when(number < 0, "-").otherwise("")
    digits = F.rtrim(F.translate(F.get(parts, F.lit(0)), "-.", ""), F.lit("0"))
    power = F.get(parts, F.lit(1)).try_cast("int")
    small = F.concat(sign, F.lit("0,"), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(digits, power + 1, F.lit("0"))
    rest = F.substring(digits, power + 2, F.length(digits))
    large = F.concat(sign, whole, F.lit(","), F.when(rest == "", "0").otherwise(rest))
    plain = F.replace(text, F.lit("."), F.lit(","))
    return F.when(~F.isnan(number), F.when(power < 0, small).when(power >= 0, large).otherwise(plain))


def exact_sum(number: Column, scale: int = 9) -> Column:
    """Sum that is the same double whatever the partitioning or the retries.

    Up to hundredths are added as whole numbers, finer amounts as decimals. An overflow fails the job.
    """
    if scale <= 2:
        return F.sum(F.rint(number * 10 ** scale).cast("long")) / F.lit(float(10 ** scale))
    return F.sum(number.cast(f"decimal(28,{scale})")).cast("double")


def exact_mean(number: Column, scale: int = 9) -> Column:
    return exact_sum(number, scale) / F.count(number)
