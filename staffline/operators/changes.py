"""Counting changes along an ordered history."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staffline.operators.history import OrderedHistory

POST = "CARGO"
PAY = "RMU"


def text_change(value: Column, previous: Column, first: Column, null_safe: bool) -> Column:
    """Whether a text differs from the row before. By default a first row and a
    move to or from null are unknown (null); ``null_safe`` counts them."""
    if null_safe:
        return first | ~value.eqNullSafe(previous)
    return ~((value == previous) | (value.isNull() & previous.isNull()))


def number_change(value: Column, previous: Column, first: Column, null_safe: bool) -> Column:
    """Whether a number differs from the row before, null counting as a value; a
    null first row is a change only with ``null_safe``."""
    differs = ~value.eqNullSafe(previous)
    return (first | differs) if null_safe else differs


def flag_changes(
    history: OrderedHistory, name: str, null_safe: bool = False
) -> OrderedHistory:
    """Mark rows where the post or the pay changed, whichever columns exist. With
    neither column every row counts as a change. The flag may be unknown (null)."""
    present = [c for c in (POST, PAY) if c in history.rows.columns]
    if not present:
        return history.with_column(name, F.lit(True))
    earlier = history.last_before("_previous", F.struct(*present))
    previous = F.col("_previous")
    first = previous.isNull()
    rules = {POST: text_change, PAY: number_change}
    changed = None
    for c in present:
        one = rules[c](F.col(c), previous[c], first, null_safe)
        changed = one if changed is None else changed | one
    return earlier.with_column(name, changed)


def flag_pay_steps(history: OrderedHistory, name: str) -> OrderedHistory:
    """Mark rows whose pay differs from the last known pay before it."""
    known = history.last_before("_known_pay", F.col(PAY))
    step = F.col(PAY).isNotNull() & (F.col(PAY) != F.col("_known_pay"))
    return known.with_column(name, step)
