"""The numbers behind all charts of a source, from one scan of its cleaned table.

Each row is read once and gives one (chart, key) pair for every chart it has a value for;
the pairs are counted together, summed up before they are moved. What must be known before,
the clip limits of histograms and their ranges, takes the quantiles' own passes over
single columns and one aggregate for all histograms. Charts of rows per key are counted in
two levels and stay by themselves, and so do the most frequent texts of a large table, see
``stats.top_values``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staffline.functions import column, strip
from staffline.operators import stats
from staffline.operators.history import union_all
from staffline.plans.sources import Chart, Source


def _name(chart: Chart) -> str:
    return f"{chart.kind}:{chart.column}"


def _alone(chart: Chart, cleaned: DataFrame) -> DataFrame:
    data = chart.data(cleaned)
    key = F.col("bin") if "bin" in data.columns else column(data.columns[0])
    return data.select(F.lit(_name(chart)).alias("chart"), key.cast("string").alias("key"), "n")


def _value(chart: Chart) -> Column:
    return chart.value() if chart.value else column(chart.column)


def _numbers(charts: list[Chart], cleaned: DataFrame) -> list[Column]:
    """The number of each histogram that a row gives, null if none or beyond the clip limit."""
    numbers = []
    for chart in charts:
        number = stats.as_number(cleaned, _value(chart))
        if chart.clip is not None:
            (limit,) = stats.quantiles(cleaned, _value(chart), [chart.clip])
            number = F.when(number <= F.lit(limit).cast("double"), number)
        numbers.append(number)
    return numbers


def _with_bins(charts: list[Chart], rows: DataFrame, first: int) -> DataFrame:
    """The rows with the numbers in their columns from ``first`` on replaced by bins. A bin
    refers to its number often, so numbers, guesses and bins are projections of their own:
    in one, what gives the number would be worked out again at each reference."""
    names = rows.columns
    binned = names[first:]
    found = rows.agg(*(f(n).alias(f"{f.__name__}_{n}") for n in binned for f in (F.min, F.max))).first()
    bins = {
        n: stats.Bins.over(found[2 * i], found[2 * i + 1], chart.bins)
        for i, (chart, n) in enumerate(zip(charts, binned))
    }
    rows = rows.select(*names, *(b.guess(F.col(n)).alias(f"guess_{n}") for n, b in bins.items()))
    return rows.select(
        *names[:first], *(b.settled(F.col(n), F.col(f"guess_{n}")).alias(n) for n, b in bins.items())
    )


def chart_rows(cleaned: DataFrame, source: Source, small_bytes: int = stats.SMALL_BYTES) -> DataFrame:
    """One row per point: chart, key, n. A histogram's key is the number of its bin. A column
    dropped as uninformative has no chart."""
    charts = [c for c in source.charts if c.value is not None or c.column in cleaned.columns]
    large = stats.size_guess(cleaned) > small_bytes
    apart = [c for c in charts if c.kind == "per_key" or (large and c.kind == "top")]
    parts = [_alone(c, cleaned) for c in apart]
    histograms = [c for c in charts if c.kind == "histogram"]
    keys: list[tuple[Chart, Column]] = []
    for chart in charts:
        if chart in apart or chart in histograms:
            continue
        if chart.kind == "year":
            key = F.year(column(chart.column).try_cast("timestamp_ntz"))
        elif chart.kind == "top":
            key = strip(column(chart.column).cast("string"))
        else:
            key = column(chart.column)
        keys.append((chart, key))
    first = len(keys)
    if histograms:
        keys += zip(histograms, _numbers(histograms, cleaned))
    if keys:
        rows = cleaned.select(*(key.alias(f"k{i}") for i, (_, key) in enumerate(keys)))
        if histograms:
            rows = _with_bins(histograms, rows, first)
        pairs = F.array(*(
            F.struct(F.lit(_name(c)).alias("chart"), F.col(f"k{i}").cast("string").alias("key"))
            for i, (c, _) in enumerate(keys)
        ))
        named = [_name(c) for c, _ in keys if c.kind == "top"]
        wanted = F.col("key").isNotNull() & ~((F.col("key") == "") & F.col("chart").isin(named))
        points = rows.select(F.inline(pairs)).where(wanted)
        counts = points.groupBy("chart", "key").agg(F.count("*").alias("n"))
        zeros = [(_name(c), str(i), 0) for c in histograms for i in range(c.bins)]
        if zeros:
            empty = cleaned.sparkSession.createDataFrame(zeros, "chart string, key string, n bigint")
            counts = counts.unionByName(empty).groupBy("chart", "key").agg(F.sum("n").alias("n"))
        tops = {_name(c): c.top for c, _ in keys if c.kind == "top"}
        if tops:
            most = F.lit(None).cast("int")
            for name, top in tops.items():
                most = F.when(F.col("chart") == name, top).otherwise(most)
            # A key of any other chart is by itself.
            rivals = Window.partitionBy("chart", F.when(most.isNull(), F.col("key"))).orderBy(F.desc("n"), "key")
            ranked = counts.withColumn("rank", F.row_number().over(rivals)).where(F.col("rank") <= max(tops.values()))
            counts = ranked.where(most.isNull() | (F.col("rank") <= most)).select("chart", "key", "n")
        parts.append(counts)
    return union_all(parts)
