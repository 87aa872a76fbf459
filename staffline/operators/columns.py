"""Whole-table cleaning: text, types, and columns that carry no information."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql import types as T

from staffline.functions import clean_text, column, strip
from staffline.functions.calendar import read_moment, within_range
from staffline.functions.flags import NO, YES, flag_from, normalised
from staffline.functions.numbers import integer_from, number_from
from staffline.operators.history import ORDINAL
from staffline.session import staged

UNKNOWN = "DESCONOCIDA"

# Fixed pattern: the suffix a repeated header name gets when read.
REPEAT_SUFFIX = r"\.\d+$"


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def replace_columns(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Replace columns in place, whatever characters their names hold."""
    return df.select(*(values.get(n, column(n)).alias(n) for n in df.columns))


def apply_steps(
    df: DataFrame, names: Iterable[str], *steps: Callable[[Column], Column]
) -> DataFrame:
    """Run the named columns through steps, one projection each: a step may refer to
    its input often without the steps before it being evaluated again."""
    names = list(names)
    for step in steps if names else ():
        df = replace_columns(df, {n: step(column(n)) for n in names})
    return df


def _strip(value: Column) -> Column:
    return strip(value.cast("string"))


def clean_strings(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Trim text columns (all by default) and null out blank cells."""
    names = text_columns(df) if names is None else names
    return apply_steps(df, names, lambda c: clean_text(c.cast("string")))


def fill_text(df: DataFrame, names: Iterable[str], value: str = UNKNOWN) -> DataFrame:
    return df.na.fill(value, subset=existing(df, names))


def cast_timestamps(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return apply_steps(df, existing(df, names), read_moment, within_range)


def cast_integers(df: DataFrame, names: Iterable[str], on_fraction: str = "error") -> DataFrame:
    chosen = existing(df, names)
    whole = [n for n in chosen if isinstance(df.schema[n].dataType, T.IntegralType)]
    spelled = [n for n in chosen if n not in whole]
    df = apply_steps(df, whole, lambda c: c.cast("bigint"))
    return apply_steps(df, spelled, _strip, lambda c: integer_from(c, on_fraction))


def cast_numbers(df: DataFrame, names: Iterable[str]) -> DataFrame:
    chosen = existing(df, names)
    numeric = [n for n in chosen if isinstance(df.schema[n].dataType, T.NumericType)]
    spelled = [n for n in chosen if n not in numeric]
    df = apply_steps(df, numeric, lambda c: c.cast("double"))
    return apply_steps(df, spelled, _strip, number_from)


def cast_flags(
    df: DataFrame, names: Iterable[str] | None = None, null_as_zero: bool = True
) -> DataFrame:
    """Yes/no columns to 1/0. Without names, the columns that hold nothing but
    yes/no spellings are found first, in one pass."""
    if names is None:
        names = flag_columns(df)
    chosen = existing(df, names)
    return apply_steps(df, chosen, normalised, lambda c: flag_from(c, null_as_zero))


def cast_trimmed(
    df: DataFrame,
    timestamps: Iterable[str] = (),
    integers: Iterable[str] = (),
    flags: Iterable[str] = (),
    numbers: Iterable[str] = (),
) -> DataFrame:
    """``cast_timestamps``, ``cast_integers``, ``cast_flags`` and ``cast_numbers`` of text
    that is trimmed already: all columns in one projection, not one for each step of each
    kind, since a projection copies the whole row. Other columns go the common way."""
    steps = {name: read_moment for name in timestamps}
    steps |= {name: integer_from for name in integers}
    steps |= {name: lambda c: flag_from(F.upper(c)) for name in flags}
    steps |= {name: number_from for name in numbers}
    asked = [*timestamps, *integers, *flags, *numbers]
    own = {n for n in existing(df, asked) if n in text_columns(df) and asked.count(n) == 1}
    df = replace_columns(df, {n: steps[n](column(n)) for n in df.columns if n in own})
    df = apply_steps(df, [n for n in timestamps if n in own], within_range)
    df = cast_timestamps(df, [n for n in timestamps if n not in own])
    df = cast_integers(df, [n for n in integers if n not in own])
    df = cast_flags(df, [n for n in flags if n not in own])
    return cast_numbers(df, [n for n in numbers if n not in own])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*(column(n) for n in df.columns if n not in set(names)))


def collapse_repeated(df: DataFrame) -> DataFrame:
    """Strip repeat suffixes from names and keep the first column of each name."""
    first: dict[str, str] = {}
    for name in df.columns:
        first.setdefault(re.sub(REPEAT_SUFFIX, "", name), name)
    return df.select(*(column(name).alias(base) for base, name in first.items()))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


@dataclass(frozen=True)
class ColumnProfile:
    """``null_ratio`` is None for a table without rows; ``flag`` unless asked for."""

    null_ratio: float | None
    constant: bool
    flag: bool | None = None


def is_missing(df: DataFrame, name: str) -> Column:
    missing = column(name).isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        missing |= F.isnan(column(name))
    return missing


def _profile_aggregates(df: DataFrame, flags: bool) -> tuple[list[str], list[Column]]:
    """A few small states per column; the reading order column is left out."""
    names = [n for n in df.columns if n != ORDINAL]
    aggregates = []
    for i, name in enumerate(names):
        missing = is_missing(df, name)
        fractional = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
        present = F.when(~missing, column(name)) if fractional else column(name)
        low, high = F.min(present), F.max(present)
        aggregates += [
            F.avg(missing.cast("double")).alias(f"nulls_{i}"),
            (low.isNull() | (low == high)).alias(f"constant_{i}"),
        ]
        if flags:
            spelled = F.bool_and(normalised(present).isin(*YES, *NO))
            aggregates.append(F.coalesce(spelled, F.lit(False)).alias(f"flag_{i}"))
    return names, aggregates


def _profiles(names: list[str], row: Mapping[str, object]) -> dict[str, ColumnProfile]:
    return {
        name: ColumnProfile(row[f"nulls_{i}"], row[f"constant_{i}"], row.get(f"flag_{i}"))
        for i, name in enumerate(names)
    }


def profile(df: DataFrame, flags: bool = False) -> dict[str, ColumnProfile]:
    """Null ratio and constancy of every column (and whether it holds nothing but
    yes/no spellings) in one aggregate, without distinct counts or a row shuffle."""
    names, aggregates = _profile_aggregates(df, flags)
    return _profiles(names, df.agg(*aggregates).first().asDict()) if names else {}


def _way_aggregates(df: DataFrame) -> tuple[list[str], list[Column]]:
    """States of ``staged_with_profile``: values present, and whether their hashes are one."""
    names, texts = [n for n in df.columns if n != ORDINAL], set(text_columns(df))
    aggregates = [F.count("*").alias("rows")]
    for i, name in enumerate(names):
        value = F.xxhash64(column(name)) if name in texts else column(name)
        value = F.when(~is_missing(df, name), value)
        aggregates += [F.count(value).alias(f"n_{i}"), (F.min(value) == F.max(value)).alias(f"alike_{i}")]
    return names, aggregates


def staged_with_profile(df: DataFrame) -> tuple[DataFrame, dict[str, ColumnProfile]]:
    """The table written once, see ``staged``, and its profile, taken while writing. What
    is behind the table runs once; later steps read only the columns they keep. Texts are
    told apart by hashes, which are cheaper to compare and keep than texts; a column of one
    hash only is read again."""
    names, aggregates = _way_aggregates(df)
    if not names:
        return df, {}
    seen, texts = Observation(), set(text_columns(df))
    out = staged(df.observe(seen, *aggregates))
    found = seen.get
    rows = found["rows"]
    constant = {name: bool(found[f"alike_{i}"] or not found[f"n_{i}"]) for i, name in enumerate(names)}
    # Texts of one hash are most likely one text; the texts themselves tell.
    doubtful = [n for i, n in enumerate(names) if n in texts and constant[n] and found[f"n_{i}"]]
    if doubtful:
        constant |= {n: p.constant for n, p in profile(out.select(*map(column, doubtful))).items()}
    return out, {
        name: ColumnProfile((rows - found[f"n_{i}"]) / rows if rows else None, constant[name])
        for i, name in enumerate(names)
    }


#: What ``profile_states`` returns; rows of several calls may be put together.
STATE = "file string, column string, rows bigint, nulls bigint, low string, high string, flags boolean"


def profile_states(df: DataFrame, file: Column) -> DataFrame:
    """One small row per file and column, from one pass: rows, nulls, smallest and largest
    value as text, whether all values are yes/no spellings. States add up: those of files
    looked at before stay valid when new files come."""
    names = [n for n in df.columns if n != ORDINAL]
    states, aggregates = [], []
    for i, name in enumerate(names):
        missing = is_missing(df, name)
        present = F.when(~missing, column(name))
        aggregates += [
            F.count_if(missing).alias(f"nulls_{i}"),
            F.min(present).cast("string").alias(f"low_{i}"),
            F.max(present).cast("string").alias(f"high_{i}"),
            F.bool_and(normalised(present).isin(*YES, *NO)).alias(f"flags_{i}"),
        ]
        states.append(F.struct(
            F.lit(name).alias("column"), F.col("rows"), F.col(f"nulls_{i}").alias("nulls"),
            F.col(f"low_{i}").alias("low"), F.col(f"high_{i}").alias("high"), F.col(f"flags_{i}").alias("flags"),
        ))
    per_file = df.groupBy(file.alias("file")).agg(F.count("*").alias("rows"), *aggregates)
    return per_file.select("file", F.inline(F.array(*states)))


def merged_profiles(states: DataFrame, names: Iterable[str]) -> dict[str, ColumnProfile]:
    """The profile of the table whose parts the states describe."""
    low, high = F.min(F.least("low", "high")), F.max(F.greatest("low", "high"))
    merged = states.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        (low.isNull() | (low == high)).alias("constant"),
        F.coalesce(F.bool_and("flags"), F.lit(False)).alias("flag"),
    )
    found = {  # a row per column
        r.column: ColumnProfile(r.nulls / r.rows if r.rows else None, r.constant, r.flag) for r in merged.collect()
    }
    return {n: found.get(n, ColumnProfile(None, True, False)) for n in names}


def sparse_columns(profiles: Mapping[str, ColumnProfile], threshold: float) -> list[str]:
    return [
        n for n, p in profiles.items() if p.null_ratio is not None and p.null_ratio >= threshold
    ]


def constant_columns(
    profiles: Mapping[str, ColumnProfile], keep: Iterable[str] = ()
) -> list[str]:
    kept = set(keep)
    return [n for n, p in profiles.items() if p.constant and n not in kept]


def flag_columns(df: DataFrame) -> list[str]:
    return [n for n, p in profile(df, flags=True).items() if p.flag]


def drop_sparse(df: DataFrame, threshold: float = 0.99) -> DataFrame:
    return drop_columns(df, sparse_columns(profile(df), threshold))


def drop_constant(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    return drop_columns(df, constant_columns(profile(df), keep))


def without_uninformative(
    df: DataFrame,
    profiles: Mapping[str, ColumnProfile],
    threshold: float = 0.99,
    keep: Iterable[str] = (),
) -> DataFrame:
    gone = {*sparse_columns(profiles, threshold), *constant_columns(profiles, keep)}
    return drop_columns(df, gone)


def drop_uninformative(
    df: DataFrame, threshold: float = 0.99, keep: Iterable[str] = ()
) -> DataFrame:
    """``drop_sparse`` then ``drop_constant``, for the price of one pass. ``keep``
    protects from the second only."""
    return without_uninformative(df, profile(df), threshold, keep)
