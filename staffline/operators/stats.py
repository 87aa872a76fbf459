"""Data-quality summaries, counts, histograms and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from staffline.functions import column, round_half_even, strip
from staffline.functions.numbers import parse_number
from staffline.operators.columns import is_missing
from staffline.operators.duplicates import duplicate_count, without_digest
from staffline.operators.sketches import RANK_ERROR, approximate_quantiles, sketch_count

# A sorted column up to this many rows is small enough for one task.
TASK_ROWS = 100_000
SKETCH_ACCURACY = 10_000

# Frequent values: counters of a sketch, candidates per value wanted, the sketch's error
# as a multiple of rows / counters, and up to which size all values are counted at once.
SKETCH_ITEMS = 10_000
SPARE = 4
SKETCH_ERROR = 3.5
SMALL_BYTES = 64 << 20

# Columns from which on rows are dear to move whole.
WIDE = 8


def size_guess(df: DataFrame) -> int:
    """Bytes of a table as Spark estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table_shape(df: DataFrame, duplicates: bool = True, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Rows, columns and, unless switched off, duplicate rows. Copies of a row fold
    together before the shuffle, so a row repeated everywhere stays cheap. Of a table with
    ``WIDE`` columns beyond ``small_bytes``, digests are shuffled instead of rows; a table
    that carries its digests, see ``with_digest``, is not read for them."""
    keyed, df = df, without_digest(df)
    width = F.lit(len(df.columns)).alias("columns")
    if not duplicates:
        return df.agg(F.count("*").alias("rows"), width)
    if len(df.columns) >= WIDE and size_guess(keyed) > small_bytes:
        return df.agg(F.count("*").alias("rows"), width, duplicate_count(keyed).alias("duplicate_rows"))
    copies = df.groupBy(*(column(n) for n in df.columns)).agg(F.count("*").alias("_copies"))
    total = F.coalesce(F.sum("_copies"), F.lit(0))
    return copies.agg(
        total.alias("rows"), width, (total - F.count("*")).alias("duplicate_rows")
    )


def null_percentages(df: DataFrame) -> DataFrame:
    """Percentage of nulls, one decimal, for the columns that have any, worst first."""
    share = F.struct(
        *(F.avg(is_missing(df, n).cast("double")).alias(str(i)) for i, n in enumerate(df.columns))
    )
    pairs = F.array(
        *(
            F.struct(F.lit(n).alias("column_name"), F.col(f"s.`{i}`").alias("ratio"))
            for i, n in enumerate(df.columns)
        )
    )
    return (
        df.agg(share.alias("s"))
        .select(F.inline(pairs))
        .where("ratio > 0")
        .select("column_name", round_half_even(F.col("ratio") * 100, 1).alias("null_pct"))
        .orderBy(F.desc("null_pct"), "column_name")
    )


def value_counts(
    df: DataFrame, name: str, keep_nulls: bool = False, by_value: bool = False
) -> DataFrame:
    """How often each value occurs, most frequent first, or in value order."""
    rows = df if keep_nulls else df.where(column(name).isNotNull())
    counts = rows.groupBy(column(name).alias(name)).agg(F.count("*").alias("n"))
    order = [column(name)] if by_value else [F.desc("n"), column(name)]
    return counts.orderBy(*order)


def proven_top(rows: DataFrame, name: str, k: int, items: int = SKETCH_ITEMS) -> list[tuple[str, int]] | None:
    """The k most frequent values of a text column with their exact counts, from two scans
    that shuffle no more than a few candidates per task; None if they prove nothing.

    A sketch of ``items`` counters, merged from one per task, overestimates a value's count by
    at most ``3.5 / items`` of all rows, and a value it has dropped occurs no more often than
    that. The ``SPARE * k`` largest estimates are the candidates and are counted exactly.
    The k-th of them is proven if it exceeds both what a dropped value may have and the
    smallest estimate among the candidates, which no other value exceeds."""
    wanted = min(SPARE * k, items)
    value = column(name)
    seen = rows.select(value.alias("x")).agg(
        F.expr(f"approx_top_k(x, {wanted}, {items})").alias("top"), F.count("x").alias("n")
    ).first()
    candidates = {r["item"]: r["count"] for r in seen.top}
    most_dropped = SKETCH_ERROR / items * seen.n
    most_left = min(candidates.values()) if len(candidates) == wanted else 0
    counted = rows.where(value.isin(list(candidates))).groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    best = [tuple(r) for r in counted.orderBy(F.desc("n"), column(name)).limit(k).collect()]
    exact = len(candidates) < wanted and most_dropped < 1
    proven = len(best) == k and best[-1][1] > max(most_dropped, most_left)
    return best if exact or proven else None


def top_values(df: DataFrame, name: str, k: int = 15, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The k most frequent non-blank texts; ties go to the smaller text. Of a table beyond
    ``small_bytes``, by Spark's estimate, the texts are not shuffled unless they must be:
    see ``proven_top``; where the proof fails, all are counted."""
    text = strip(column(name).cast("string"))
    rows = df.select(text.alias(name)).where(column(name) != "")
    if size_guess(df) > small_bytes and (best := proven_top(rows, name, k)) is not None:
        return df.sparkSession.createDataFrame(best, T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())])).orderBy(F.desc("n"), column(name))
    return value_counts(rows, name).limit(k)


def rows_per_year(df: DataFrame, name: str) -> DataFrame:
    moment = column(name).try_cast("timestamp_ntz")
    return value_counts(df.select(F.year(moment).alias("year")), "year", by_value=True)


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(column(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class _Span:
    """Where a rank is known to lie: between two values, both excluded, as the
    ``rank``-th of ``size`` rows."""

    rank: int
    size: int
    low: float | None = None
    high: float | None = None

    def rows(self) -> Column:
        x = F.col("x")
        inside = F.lit(True)
        if self.low is not None:
            inside &= x > self.low
        if self.high is not None:
            inside &= x < self.high
        return inside

    def edges(self, reach: float = 2.0 / SKETCH_ACCURACY) -> tuple[float, float]:
        # On the sketch's own grid, so that neighbouring ranks share a bracket.
        middle = round((self.rank + 0.5) / self.size * SKETCH_ACCURACY) / SKETCH_ACCURACY
        return max(0.0, middle - reach), min(1.0, middle + reach)


def _aggregate(rows: DataFrame, wanted: dict[tuple, Column]) -> dict[tuple, object]:
    """Named aggregates in one pass."""
    row = rows.agg(*(c.alias(str(i)) for i, c in enumerate(wanted.values()))).first()
    return dict(zip(wanted, row))


class _StaleSketch(Exception):
    """A sketch that stands for another number of values than there are."""


def _rank_values(
    values: DataFrame,
    ranks: Sequence[int],
    total: int,
    task_rows: int,
    sketch: bytearray | None = None,
) -> dict[int, float]:
    """The values at 0-based ranks among ``total`` sorted values ``x``. A sketch
    brackets each rank; counting around the brackets tells exactly where the ranks
    lie, and only rows inside an open bracket are looked at again. The data is
    scanned a few times but never sorted or shuffled as a whole. A ``sketch`` kept from
    before gives the first brackets without a scan."""
    x = F.col("x")
    found: dict[int, float] = {}
    spans = {rank: _Span(rank, total) for rank in ranks}
    while wide := {r: s for r, s in spans.items() if s.size > task_rows}:
        counts: dict[tuple, Column] = {("rows",): F.count("*")}
        if sketch is not None:
            reach = {(s.low, s.high, *s.edges()): s.edges(2 * RANK_ERROR) for s in wide.values()}
            asked = sorted({p for pair in reach.values() for p in pair})
            given = dict(zip(asked, approximate_quantiles(values.sparkSession, sketch, asked)))
            brackets = {key: [given[p] for p in pair] for key, pair in reach.items()}
        else:
            brackets = _aggregate(values, {
                (s.low, s.high, *s.edges()): F.percentile_approx(
                    F.when(s.rows(), x), list(s.edges()), SKETCH_ACCURACY
                )
                for s in wide.values()
            })
        for s in wide.values():
            low, high = brackets[s.low, s.high, *s.edges()]
            where = (s.low, s.high, low, high)
            counts[*where, "below"] = F.count_if(s.rows() & (x < low))
            counts[*where, "at low"] = F.count_if(x == low)
            counts[*where, "between"] = F.count_if((x > low) & (x < high))
            counts[*where, "at high"] = F.count_if((x == high) & (x > low))
        counted = _aggregate(values, counts)
        if sketch is not None and counted["rows",] != total:
            raise _StaleSketch
        sketch = None
        for rank, s in wide.items():
            low, high = brackets[s.low, s.high, *s.edges()]
            where = (s.low, s.high, low, high)
            below = counted[*where, "below"]
            inner = below + counted[*where, "at low"]
            upper = inner + counted[*where, "between"]
            above = upper + counted[*where, "at high"]
            if s.rank < below:
                spans[rank] = _Span(s.rank, below, s.low, low)
            elif s.rank < inner:
                found[rank] = low
            elif s.rank < upper:
                spans[rank] = _Span(s.rank - inner, upper - inner, low, high)
            elif s.rank < above:
                found[rank] = high
            else:
                spans[rank] = _Span(s.rank - above, s.size - above, high, s.high)
            if rank in found:
                del spans[rank]

    shared: dict[tuple, list[int]] = {}
    for rank, s in spans.items():
        shared.setdefault((s.low, s.high), []).append(rank)
    so_far = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for own in shared.values():
        inside = values.where(spans[own[0]].rows()).groupBy("x").count()
        reached = inside.withColumn("reached", F.sum("count").over(so_far))
        found |= _aggregate(
            reached, {r: F.min(F.when(F.col("reached") > spans[r].rank, x)) for r in own}
        )
    return found


def as_number(df: DataFrame, value: Column) -> Column:
    """A value as a double; null if it is NaN or text that is no number."""
    numeric = isinstance(df.select(value.alias("x")).schema["x"].dataType, T.NumericType)
    number = value.cast("double") if numeric else parse_number(value)
    return F.when(~F.isnan(number), number)


def _numbers(df: DataFrame, value: Column) -> DataFrame:
    """A value's numbers as column ``x``; nulls, NaN and non-numeric text left out."""
    x = F.col("x")
    raw = df.select(value.alias("x"))
    numeric = isinstance(raw.schema["x"].dataType, T.NumericType)
    number = x.cast("double") if numeric else parse_number(x)
    return raw.select(number.alias("x")).where(x.isNotNull() & ~F.isnan(x))


def quantiles(
    df: DataFrame,
    value: Column,
    probabilities: Sequence[float],
    task_rows: int = TASK_ROWS,
    sketch: bytearray | None = None,
) -> list[float | None]:
    """Exact quantiles with linear interpolation, nulls and NaN left out. Up to
    ``task_rows`` values one aggregate does; beyond, ranks are found by narrowing. A
    ``sketch`` of the values, see ``sketches``, spares two scans; one that stands for
    another number of values is not used."""
    values = _numbers(df, value)
    total = sketch_count(df.sparkSession, sketch) if sketch is not None else 0
    if total <= task_rows:
        sketch, total = None, values.count()
    if not total:
        return [None] * len(probabilities)
    if total <= task_rows:
        return list(values.agg(F.percentile("x", list(probabilities))).first()[0])

    places = [(total - 1) * p for p in probabilities]
    pairs = [(int(place), min(int(place) + 1, total - 1)) for place in places]
    ranks = sorted({r for pair in pairs for r in pair})
    try:
        found = _rank_values(values, ranks, total, task_rows, sketch)
    except _StaleSketch:
        return quantiles(df, value, probabilities, task_rows)
    return [
        _between(found[lower], found[upper], lower + 1 - place, place - lower)
        for place, (lower, upper) in zip(places, pairs)
    ]


def _between(low: float, high: float, of_low: float, of_high: float) -> float:
    """Part of the way from low to high; infinities stay what they are."""
    if of_high == 0 or low == high:
        return low
    return of_low * low + of_high * high


def describe(
    df: DataFrame, name: str, task_rows: int = TASK_ROWS, sketch: bytearray | None = None
) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum."""
    quarter, half, three = quantiles(df, column(name), [0.25, 0.5, 0.75], task_rows, sketch)
    x = F.when(~is_missing(df, name), column(name).cast("double"))
    return df.agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.lit(quarter).cast("double").alias("p25"),
        F.lit(half).cast("double").alias("p50"),
        F.lit(three).cast("double").alias("p75"),
        F.max(x).alias("max"),
    )


def iqr_bounds(
    df: DataFrame,
    name: str,
    factor: float = 1.5,
    task_rows: int = TASK_ROWS,
    sketch: bytearray | None = None,
    approximate: bool = False,
) -> tuple[float | None, float | None]:
    """The box-plot whiskers. ``approximate`` takes the quartiles from the sketch alone, off
    by its rank error, without a scan."""
    if approximate:
        low, high = approximate_quantiles(df.sparkSession, sketch, [0.25, 0.75])
    else:
        low, high = quantiles(df, column(name), [0.25, 0.75], task_rows, sketch)
    if low is None:
        return None, None
    return low - factor * (high - low), high + factor * (high - low)


def iqr_outliers(
    df: DataFrame,
    name: str,
    factor: float = 1.5,
    task_rows: int = TASK_ROWS,
    sketch: bytearray | None = None,
    approximate: bool = False,
) -> tuple[Column, float | None, float | None]:
    """A never-null filter for values beyond the box-plot whiskers, and the bounds."""
    low, high = iqr_bounds(df, name, factor, task_rows, sketch, approximate)
    if low is None:
        return F.lit(False), None, None
    value = column(name).cast("double")
    outside = (value < low) | ((value > high) & ~F.isnan(value))
    return F.coalesce(outside, F.lit(False)), low, high


@dataclass(frozen=True)
class Bins:
    """Equal-width bins from ``low`` to ``high``, the last one closed."""

    low: float
    high: float
    n: int

    @classmethod
    def over(cls, low: float | None, high: float | None, n: int) -> Bins:
        """Bins for values of this range; none, or one value only, gets a range of 1."""
        if low is None:
            low, high = 0.0, 1.0
        if low == high:
            low, high = low - 0.5, high + 0.5
        return cls(low, high, n)

    def edge(self, i: Column) -> Column:
        step = (self.high - self.low) / self.n
        return F.when(i == self.n, F.lit(self.high)).otherwise(i * F.lit(step) + F.lit(self.low))

    def of(self, x: Column) -> Column:
        """The bin of a value within the range. Both steps refer to ``x`` often: where it is
        dear, take them in projections of their own."""
        return self.settled(x, self.guess(x))

    def guess(self, x: Column) -> Column:
        """The bin by division, which may land a value one bin off an edge."""
        return F.least(F.floor((x - self.low) * F.lit(self.n / (self.high - self.low))).cast("int"), F.lit(self.n - 1))

    def settled(self, x: Column, guess: Column) -> Column:
        """The bin once the edges around a guess have decided."""
        last = F.lit(self.n - 1)
        placed = (
            F.when(x < self.edge(guess), guess - 1)
            .when((x >= self.edge(guess + 1)) & (guess != last), guess + 1)
            .otherwise(guess)
        )
        return F.when(x.isNotNull(), placed)


def histogram(
    df: DataFrame,
    value: Column,
    bins: int = 30,
    clip: float | None = 0.99,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Counts in equal-width bins, the last one closed, values beyond the ``clip``
    quantile left out. Every bin is listed; a value that is no number is ignored."""
    spark = df.sparkSession
    x = F.col("x")
    data = _numbers(df, value)
    if clip is not None:
        (limit,) = quantiles(data, x, [clip], task_rows)
        data = data.where(x <= F.lit(limit).cast("double"))
    low, high = data.agg(F.min("x"), F.max("x")).first()
    all_bins = Bins.over(low, high, bins)
    counts = data.groupBy(all_bins.of(x).alias("bin")).agg(F.count("*").alias("n"))
    slots = spark.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return (
        slots.join(counts, "bin", "left")
        .select(
            "bin",
            all_bins.edge(F.col("bin")).alias("lower"),
            all_bins.edge(F.col("bin") + 1).alias("upper"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        )
        .orderBy("bin")
    )


def rows_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of two stages and how many rows went between them."""
    none = F.lit(0).cast("bigint")
    counts = before.agg(F.count("*").alias("b"), none.alias("a")).unionByName(
        after.agg(none.alias("b"), F.count("*").alias("a"))
    )
    return _removed(counts, F.sum("b"), F.sum("a"))


def duplicates_removed(df: DataFrame) -> DataFrame:
    """``rows_removed`` by dropping repeated rows, in one scan: copies fold together
    before the shuffle."""
    copies = df.groupBy(*(column(n) for n in df.columns)).agg(F.count("*").alias("_copies"))
    return _removed(copies, F.coalesce(F.sum("_copies"), F.lit(0)), F.count("*"))


def _removed(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    return rows.agg(
        before.alias("rows_before"),
        after.alias("rows_after"),
        (before - after).alias("rows_removed"),
    )
