"""Small derived values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from staffline.functions.text import strip


def round_half_even(value: Column, digits: int) -> Column:
    """Round the way numpy does: scale, round half to even, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null on a zero denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def term_flags(terms: Sequence[Column]) -> list[Column]:
    """1 for each term column that holds any text once trimmed, else 0."""
    return [(strip(F.coalesce(t.cast("string"), F.lit(""))) != "").cast("int") for t in terms]


def active_terms(flags: Sequence[Column], none_label: str = "SIN_TERMINO") -> Column:
    """``1-3`` for active first and third terms; a label when none is active."""
    numbers = [F.when(flag == 1, F.lit(str(i))) for i, flag in enumerate(flags, start=1)]
    joined = F.concat_ws("-", *numbers)
    return F.when(joined == "", F.lit(none_label)).otherwise(joined)
