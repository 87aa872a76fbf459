"""Tolerant numeric parsing.

Casts are guarded by patterns: a cast accepts a type suffix as in ``1d``, and one
that fails costs an exception per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staffline.functions.text import strip

# Fixed patterns: what counts as a number, and as a whole one.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DIGITS = r"^[+-]?\d+$"
DIGITS_AND_ZEROS = r"^[+-]?\d+\.0*$"


def number_from(text: Column) -> Column:
    """Trimmed text to double; null when it is not a number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def integer_from(text: Column, on_fraction: str = "error") -> Column:
    """Trimmed number-like text to bigint, null otherwise. Plain digits never pass
    through a double, so identifiers beyond 2^53 stay exact. A true fraction raises,
    or reads as null with ``on_fraction="null"``."""
    if on_fraction not in ("error", "null"):
        raise ValueError("on_fraction must be 'error' or 'null'")
    number = text.try_cast("double")
    whole = F.when(number == F.rint(number), number.try_cast("bigint"))
    if on_fraction == "error":
        message = F.concat(F.lit("not a whole number: "), text)
        whole = F.when(
            number != F.rint(number), F.raise_error(message).cast("bigint")
        ).otherwise(whole)
    return (
        F.when(text.rlike(DIGITS), text.try_cast("bigint"))
        .when(text.rlike(DIGITS_AND_ZEROS), F.substring_index(text, ".", 1).try_cast("bigint"))
        .when(text.rlike(NUMBER), whole)
    )


def parse_number(value: Column) -> Column:
    return number_from(strip(value.cast("string")))


def parse_integer(value: Column, on_fraction: str = "error") -> Column:
    return integer_from(strip(value.cast("string")), on_fraction)
