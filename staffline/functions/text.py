"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Python's str.strip() removes; derived, not listed.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Cells read as null (the pandas CSV defaults, plus a lone space).
NULL_TOKENS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Texts that mean null once a cell is trimmed.
BLANK_AFTER_TRIM = ("", "nan", "None")


def column(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_if_token(value: Column) -> Column:
    return F.when(~value.isin(*NULL_TOKENS), value)


def nothing_to_trim(value: Column) -> Column:
    """Whether a text begins and ends in printable ASCII other than space."""
    last = F.substring(value, -1, 1)
    return (value >= "!") & (value < "\x7f") & (last >= "!") & (last < "\x7f")


def strip(value: Column) -> Column:
    """Trim all Unicode whitespace; Spark's plain trim only knows the space. Texts
    that plainly need no trimming, which is most of them, are told apart first."""
    return F.when(nothing_to_trim(value), value).otherwise(F.trim(value, F.lit(WHITESPACE)))


def blank_to_null(trimmed: Column) -> Column:
    return F.when(~trimmed.isin(*BLANK_AFTER_TRIM), trimmed)


def clean_text(value: Column) -> Column:
    """``strip``, then ``blank_to_null``, as one step: only what needs trimming is trimmed."""
    trimmed = F.trim(value, F.lit(WHITESPACE))
    return F.when(nothing_to_trim(value), blank_to_null(value)).otherwise(blank_to_null(trimmed))


def repair_soft_hyphen(value: Column) -> Column:
    """Undo a known export fault: U+FFFD followed by a soft hyphen stood for an i."""
    return F.replace(value, F.lit("\ufffd\u00ad"), F.lit("i"))
