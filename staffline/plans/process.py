"""Raw extract to processed tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from staffline.operators.columns import (
    ColumnProfile,
    cast_trimmed,
    clean_strings,
    collapse_repeated,
    drop_columns,
    drop_duplicate_rows,
    fill_text,
    profile,
    staged_with_profile,
    without_uninformative,
)
from staffline.operators.decode import override_from
from staffline.operators.duplicates import without_duplicates
from staffline.operators.features import person_features
from staffline.operators.history import HOT_ROWS, ORDINAL, union_all
from staffline.operators.periods import continuous_periods, period_count_distribution
from staffline.operators.stats import (
    SMALL_BYTES,
    describe,
    iqr_outliers,
    null_percentages,
    rows_removed,
    size_guess,
    table_shape,
)
from staffline.plans.charts import chart_rows
from staffline.plans.profiles import stored_profiles
from staffline.plans.sources import (
    FEATURES_OUTPUT,
    HISTORY_OUTPUT,
    HISTORY_UNUSED,
    PERIODS_OUTPUT,
    SOURCES,
    Source,
)
from staffline.session import staged
from staffline.sources.csv import read_csv
from staffline.sources.sinks import write_table


def trimmed(raw: DataFrame, source: Source) -> DataFrame:
    """A raw table's trimmed text, under the names that count."""
    df = source.prepare(raw) if source.prepare else raw
    df = df.withColumnsRenamed(dict(source.rename))
    df = clean_strings(df)
    if source.collapse:
        df = collapse_repeated(df)
    if source.fill:
        df = fill_text(df, source.fill)
    return df


def clean_source(
    raw: DataFrame,
    source: Source,
    profiles: Mapping[str, ColumnProfile] | None = None,
    stage: bool = False,
) -> DataFrame:
    """Clean and type a raw table. Its profile decides which columns survive; later steps
    read no others; columns that go whatever they hold are left out before it, unless repeated
    rows are told by them. ``stage`` is for input that is dear to read twice: the trimmed text is
    then written once to the shared folder and profiled on the way. ``profiles``: what is
    known already, see ``stored_profiles``."""
    df = trimmed(raw, source)
    if not source.dedupe:
        df = drop_columns(df, source.drop)
    if profiles is None:
        df, profiles = staged_with_profile(df) if stage else (df, profile(df))
    df = without_uninformative(df, profiles, source.sparse_from, source.keep)
    if source.dedupe:
        df = without_duplicates(df) if size_guess(df) > SMALL_BYTES else drop_duplicate_rows(df)
        df = drop_columns(df, source.drop)
    if source.decode:
        df = source.decode(df)
    df = cast_trimmed(df, source.timestamps, source.integers, source.flags, source.numbers)
    return source.derive(df) if source.derive else df


def summary_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and duplicate rows of a table before and after cleaning."""
    return union_all([
        table_shape(df.drop(ORDINAL)).withColumn("stage", F.lit(stage))
        for stage, df in (("before", before), ("after", after))
    ])


def pay_review(contracts: DataFrame) -> DataFrame:
    """Contracts whose pay lies beyond the box-plot whiskers, largest first, to be looked
    at by people; their corrections go to ``process_source``."""
    mask, _, _ = iqr_outliers(contracts, "RMU")
    return contracts.where(mask).orderBy(F.desc("RMU"), "IDCONTRATOLABORAL")


def write_reports(
    raw: DataFrame, tables: dict[str, DataFrame], source: Source, out_dir: str
) -> dict[str, str]:
    """What people look at besides the tables; report name -> path written."""
    cleaned = tables[source.output]
    reports = {"summary": summary_rows(raw, cleaned)}
    nulls = {"before": raw.drop(ORDINAL), "after": cleaned}
    reports["nulls"] = union_all(
        [null_percentages(df).withColumn("stage", F.lit(stage)) for stage, df in nulls.items()]
    )
    if source.charts:
        reports["charts"] = chart_rows(cleaned, source)
    if source.dedupe:
        reports["removed"] = rows_removed(raw, cleaned)
    if source.output == HISTORY_OUTPUT:
        reports["periods"] = period_count_distribution(tables[PERIODS_OUTPUT])
        if "RMU" in cleaned.columns:
            reports["pay"] = describe(cleaned, "RMU")
            reports["pay_review"] = pay_review(cleaned)
    return {
        f"{source.output}_{name}": write_table(df, f"{out_dir}/reports/{source.output}_{name}")
        for name, df in reports.items()
    }


def history_contracts(cleaned: DataFrame) -> DataFrame:
    return drop_columns(cleaned, HISTORY_UNUSED)


def history_tables(
    cleaned: DataFrame, as_of: str | date, hot_rows: int | None = HOT_ROWS
) -> dict[str, DataFrame]:
    """The work history's three tables: contracts without unused columns, continuous
    periods, and person features, which still see every column."""
    contracts = history_contracts(cleaned)
    periods = continuous_periods(contracts, as_of, hot_rows=hot_rows)
    features = person_features(cleaned, periods, as_of, hot_rows=hot_rows)
    return {HISTORY_OUTPUT: contracts, PERIODS_OUTPUT: periods, FEATURES_OUTPUT: features}


def processed_tables(
    raw: DataFrame,
    source: Source,
    as_of: str | date,
    hot_rows: int | None = HOT_ROWS,
    corrections: DataFrame | None = None,
    profiles: Mapping[str, ColumnProfile] | None = None,
    stage: bool = False,
) -> dict[str, DataFrame]:
    """All tables one source gives. The cleaned work history feeds three of them and
    is staged, so that the raw extract is parsed for it only once. ``corrections`` holds
    values to overlay: the column to find a row by, then the column to correct."""
    cleaned = clean_source(raw, source, profiles, stage)
    if corrections is not None:
        cleaned = override_from(cleaned, corrections, *corrections.columns)
    if source.output == HISTORY_OUTPUT:
        return history_tables(staged(cleaned), as_of, hot_rows)
    return {source.output: cleaned}


def process_source(
    spark: SparkSession,
    source: Source,
    raw_dir: str,
    out_dir: str,
    as_of: str | date,
    fmt: str = "parquet",
    corrections: DataFrame | None = None,
    reports: bool = False,
    profile_store: str | None = None,
) -> dict[str, str]:
    """Read, clean and write one source; output name -> path written. ``reports`` adds
    summaries before and after, chart data and, for the work history, the pay review. With
    a ``profile_store`` only files that are new there are profiled."""
    path = f"{raw_dir}/{source.file}.csv"
    raw = read_csv(spark, path, with_ordinal=source.output == HISTORY_OUTPUT)
    profiles = None
    if profile_store is not None:
        names = [n for n in trimmed(raw, source).columns if n != ORDINAL]
        profiles = stored_profiles(spark, source, path, f"{profile_store}/{source.output}", names, trimmed)
    tables = processed_tables(raw, source, as_of, corrections=corrections, profiles=profiles, stage=True)
    written = {
        name: write_table(table, f"{out_dir}/{name}", fmt) for name, table in tables.items()
    }
    if reports:
        if fmt == "parquet":
            tables = {name: spark.read.parquet(path) for name, path in written.items()}
        written |= write_reports(raw, tables, source, out_dir)
    return written


def process_all(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    as_of: str | date,
    sources: Iterable[Source] = SOURCES,
    fmt: str = "parquet",
    reports: bool = False,
) -> dict[str, str]:
    written: dict[str, str] = {}
    for source in sources:
        written |= process_source(spark, source, raw_dir, out_dir, as_of, fmt, reports=reports)
    return written
