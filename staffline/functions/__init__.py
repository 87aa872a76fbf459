"""Column expressions: text, dates, numbers, flags and derived values."""

from staffline.functions.calendar import (
    age_in_years,
    days_between,
    effective_end,
    elapsed_years,
    month_cut_continues,
    ntz,
    parse_timestamp,
)
from staffline.functions.derived import active_terms, ratio, round_half_even, term_flags
from staffline.functions.flags import yes_no
from staffline.functions.numbers import parse_integer, parse_number
from staffline.functions.text import (
    clean_text,
    column,
    null_if_token,
    repair_soft_hyphen,
    strip,
)

__all__ = [
    "active_terms",
    "age_in_years",
    "clean_text",
    "column",
    "days_between",
    "effective_end",
    "elapsed_years",
    "month_cut_continues",
    "ntz",
    "null_if_token",
    "parse_integer",
    "parse_number",
    "parse_timestamp",
    "ratio",
    "repair_soft_hyphen",
    "round_half_even",
    "strip",
    "term_flags",
    "yes_no",
]
