"""Column profiles kept between runs.

An extract is looked at file by file, and what is found of a file is kept: a few small
values per column, see ``profile_states``. A later run reads only files that are new or
have changed, adds what it finds to the store, and puts the states of all present files
together. Which columns survive is hence known without reading the extract again, and only
these columns need to be typed and written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from staffline.operators.columns import STATE, ColumnProfile, merged_profiles, profile_states
from staffline.operators.history import ORDINAL
from staffline.plans.sources import Source
from staffline.session import staged
from staffline.sources.csv import read_csv

_VERSION = "modified timestamp, length bigint"


def present_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of an extract: file, modified, length. Their content is not read."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.select(
        F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("modified"), "length")


def _known(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{STATE}, {_VERSION}")


def stored_profiles(
    spark: SparkSession, source: Source, path: str, store: str, names: list[str], trimmed
) -> dict[str, ColumnProfile]:
    """The profile of the extract at ``path``, of the columns ``names``. ``trimmed`` turns
    raw rows into the rows that are profiled. A file without rows leaves no state and is
    looked at each time."""
    key = ["file", "modified", "length"]
    present = staged(present_files(spark, path).where("length > 0"))
    new = present.join(_known(spark, store).select(*key).distinct(), key, "left_anti")
    paths = [r.file for r in new.select("file").orderBy("file").collect()]  # a row per new file
    if paths:
        raw = read_csv(spark, paths, with_ordinal=True)
        states = profile_states(trimmed(raw, source), F.col(f"{ORDINAL}.file"))
        states.join(present, "file").write.mode("append").parquet(store)
    return merged_profiles(_known(spark, store).join(present, key, "left_semi"), names)
