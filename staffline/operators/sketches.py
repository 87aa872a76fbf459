"""Quantile sketches that are kept and added up.

A sketch sums up a column's numbers in some ten kilobytes. Sketches of files, days or
partitions are stored as rows and merged as needed, so quantiles of everything so far cost
no scan of it. By themselves they give approximate quantiles: the value returned for a
probability has a rank off by no more than ``RANK_ERROR`` of all values (with a confidence
of 99 %). Handed to ``stats.quantiles`` they spare its first scans; its results stay exact,
whatever the sketch."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staffline.functions import column
from staffline.functions.numbers import parse_number

#: Size of a sketch, and the rank error that follows from it: 2.296 / size ** 0.9021.
SKETCH_SIZE = 4096
RANK_ERROR = 2.296 / SKETCH_SIZE**0.9021


def _sketch(df: DataFrame, name: str) -> Column:
    """Of a column's numbers; nulls, NaN and text that is no number are left out."""
    numeric = dict(df.dtypes)[name] not in ("string", "binary")
    number = column(name).cast("double") if numeric else parse_number(column(name))
    return F.call_function("kll_sketch_agg_double", F.when(~F.isnan(number), number), F.lit(SKETCH_SIZE))


def sketch_states(df: DataFrame, names: Iterable[str], part: Column) -> DataFrame:
    """One row per part and column, from one pass: part, column, sketch."""
    names = list(names)
    states = [F.struct(F.lit(n).alias("column"), F.col(f"s{i}").alias("sketch")) for i, n in enumerate(names)]
    sketches = df.groupBy(part.cast("string").alias("part")).agg(
        *[_sketch(df, n).alias(f"s{i}") for i, n in enumerate(names)])
    return sketches.select("part", F.inline(F.array(*states)))


def merged_sketch(states: DataFrame, name: str) -> bytearray:
    """The sketch of a column's numbers in all parts; one of no numbers without states."""
    return states.where(F.col("column") == name).agg(F.expr("kll_merge_agg_double(sketch)")).first()[0]


def sketch_count(spark: SparkSession, sketch: bytearray | None) -> int:
    """How many numbers a sketch stands for."""
    if sketch is None:
        return 0
    return spark.range(1).select(F.call_function("kll_sketch_get_n_double", F.lit(sketch))).first()[0]


def approximate_quantiles(
    spark: SparkSession, sketch: bytearray | None, probabilities: Sequence[float]
) -> list[float | None]:
    """Values whose ranks are off by ``RANK_ERROR`` of the count at most."""
    if not sketch_count(spark, sketch) or not probabilities:
        return [None] * len(probabilities)
    asked = F.array(*(F.lit(float(p)) for p in probabilities))
    return list(spark.range(1).select(F.call_function("kll_sketch_get_quantile_double", F.lit(sketch), asked)).first()[0])
