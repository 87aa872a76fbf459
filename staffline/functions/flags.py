"""Yes/no columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staffline.functions.text import strip

# Accepted spellings, compared trimmed and in upper case.
YES = ("S", "SI", "1")
NO = ("N", "NO", "0")


def normalised(value: Column) -> Column:
    return F.upper(strip(value.cast("string")))


def flag_from(normal: Column, null_as_zero: bool = True) -> Column:
    flag = F.when(normal.isin(*YES), 1).when(normal.isin(*NO), 0).cast("bigint")
    return F.coalesce(flag, F.lit(0).cast("bigint")) if null_as_zero else flag


def yes_no(value: Column, null_as_zero: bool = True) -> Column:
    """1 or 0. Null and unknown texts are 0, or null without ``null_as_zero``."""
    return flag_from(normalised(value), null_as_zero)
