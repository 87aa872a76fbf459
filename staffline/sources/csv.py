"""Raw CSV extracts, every cell as text.

One aggregation over the lines of all files, which splits like any text scan, finds each
file's encoding, quoting and header. Ordinary files, those of one encoding and header
together, are read by Spark's CSV reader with an explicit all-text schema and put together
by column name. Files with an odd number of quotes on some line may have cells that span
lines; ``records`` finds their records split by split and joins lines only where a record
has several. Only a file whose quotes or line ends follow no rule is read by one task, as
a stream. The number of jobs does not depend on the number of files. Bytes of a code page
other than UTF-8 are read as latin-1 and translated cell by cell."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from staffline.functions import column, null_if_token
from staffline.operators.columns import apply_steps
from staffline.operators.history import ORDINAL, union_all
from staffline.sources.records import WELL_FORMED, Records, find_records

UTF8, CP1252, LATIN1 = "utf-8", "cp1252", "latin-1"

# Bytes the cp1252 code page does not define, and those it maps elsewhere than
# latin-1 does; both follow from the code page itself.
_HIGH = range(0x80, 0xA0)
_DEFINED = {b: bytes([b]).decode(CP1252, "ignore") for b in _HIGH}
UNDEFINED_IN_CP1252 = "".join(chr(b) for b, c in _DEFINED.items() if not c)
_AS_LATIN1 = "".join(chr(b) for b, c in _DEFINED.items() if c)
_AS_CP1252 = "".join(c for c in _DEFINED.values() if c)

# Marks cells beyond the header's width, and what an absent cell is told apart by.
_SURPLUS = "_surplus"
_ABSENT = "\u0001absent\u0001"


@dataclass(frozen=True)
class CsvTraits:
    """What one file is like. ``whole``: it must be read by one task."""

    path: str
    encoding: str
    header: tuple[str, ...]
    breaks_in_cells: bool
    whole: bool = False


def column_names(header: Iterable[str]) -> tuple[str, ...]:
    """Header cells as unique names: a repeat gets ``.1``, ``.2``, ...; a blank one
    is named by position."""
    names: list[str] = []
    seen: set[str] = set()
    cells = [cell if cell else f"Unnamed: {i}" for i, cell in enumerate(header)]
    taken = set(cells)
    for cell in cells:
        name, repeat = cell, 0
        while name in seen or (repeat and name in taken):
            repeat += 1
            name = f"{cell}.{repeat}"
        seen.add(name)
        names.append(name)
    return tuple(names)


def _reader(spark: SparkSession, encoding: str, whole: bool):
    return (
        spark.read.option("quote", '"')
        .option("escape", '"')
        .option("multiLine", whole)
        .option("encoding", "UTF-8" if encoding == UTF8 else "ISO-8859-1")
        .option("nullValue", _ABSENT)
        .option("emptyValue", "")
    )


def _header(spark: SparkSession, path: str, encoding: str, whole: bool) -> tuple[str, ...]:
    """The first record of a file that follows no rule; the reader stops after it."""
    first = _reader(spark, encoding, whole).option("header", False).csv(path).head(1)
    return _named(["" if c is None else c for c in first[0]] if first else [], encoding)


def _named(cells: list[str], encoding: str) -> tuple[str, ...]:
    if cells:
        cells[0] = cells[0].removeprefix("\ufeff")
    if encoding == CP1252:
        cells = [c.translate(str.maketrans(_AS_LATIN1, _AS_CP1252)) for c in cells]
    return column_names(cells)


def _cells(record: str) -> list[str] | None:
    """The cells of a well-formed record."""
    if not re.fullmatch(WELL_FORMED, record.removeprefix("\ufeff")):
        return None
    return next(csv.reader(io.StringIO(record.removeprefix("\ufeff"), newline="")), [])


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of all files; the text reader hands bytes through undecoded."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), _position().alias("at"))


def _look(spark: SparkSession, path: str | list[str], encoding: str | None) -> tuple[list[CsvTraits], Records | None]:
    """What every file is like and, if some may have cells that span lines, their records."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    as_latin1 = F.decode(value.cast("binary"), "ISO-8859-1")
    first = lambda c, told: F.min_by(c, F.when(told, F.col("at")))
    files = (
        _lines(spark, path)
        .groupBy("path")
        .agg(
            F.bool_and(F.is_valid_utf8("value")).alias("valid"),
            F.bool_or(as_latin1.rlike(f"[{UNDEFINED_IN_CP1252}]")).alias("stray"),
            F.bool_or(quotes % 2 == 1).alias("odd"),
            F.bool_or(F.contains(value, F.lit("\r")) & as_latin1.rlike(r"(?s)\r.")).alias("lone_cr"),
            first(F.endswith(value, F.lit("\r")), F.lit(True)).alias("crlf"),
            # The reader skips lines of nothing but white space.
            first(value.cast("binary"), as_latin1.rlike(r"[^\x00-\x20]")).alias("head"),
        )
        .orderBy("path")
        .collect()  # a row per file
    )
    looked = []
    for file in files:
        own = encoding or (UTF8 if file.valid else LATIN1 if file.stray else CP1252)
        cells = None
        if not file.odd and not file.lone_cr:
            head = (file.head or b"").decode("utf-8" if own == UTF8 else "latin-1", "replace")
            cells = _cells(head.removesuffix("\r")) if head else []
        header = None if cells is None else _named(cells, own)
        looked.append((CsvTraits(file.path, own, header, bool(file.odd)), file))
    broken = [(t.path, t.encoding != UTF8, f.crlf) for t, f in looked if f.odd and not f.lone_cr]
    records = find_records(_lines(spark, [path for path, _, _ in broken]), broken) if broken else None
    heads = records.heads if records else {}
    traits = []
    for file, _ in looked:
        if file.header is None:
            cells = _cells(heads[file.path]) if file.path in heads else None
            if cells is None:
                header = _header(spark, file.path, file.encoding, file.breaks_in_cells)
                file = replace(file, header=header, whole=file.breaks_in_cells)
            else:
                file = replace(file, header=_named(cells, file.encoding))
        traits.append(file)
    return traits, records


def inspect_csv(spark: SparkSession, path: str, encoding: str | None = None) -> list[CsvTraits]:
    """For each file the first of UTF-8, cp1252 and latin-1 that decodes it, its column
    names, and whether a cell may span lines."""
    return _look(spark, path, encoding)[0]


def _schema(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _position() -> Column:
    """Where a row stands: file by file, block by block, row by row within a block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _fitting(
    rows: DataFrame, header: tuple[str, ...], encoding: str, path: Column, at: Column, own: Column | None = None
) -> DataFrame:
    """A row with more cells than the header raises, if it is a row of its ``own``."""
    complaint = F.concat(F.lit("a row has more cells than the header: "), path)
    fits = F.when(F.col(_SURPLUS).isNull() if own is None else ~own | F.col(_SURPLUS).isNull(), True).otherwise(
        F.raise_error(complaint).cast("boolean")
    )
    df = rows.where(fits).select(*(column(n) for n in header), at.alias(ORDINAL))
    if encoding == CP1252:
        df = apply_steps(df, header, lambda c: F.translate(c, _AS_LATIN1, _AS_CP1252))
    return df


def _read_alike(
    spark: SparkSession, paths: list[str], encoding: str, header: tuple[str, ...], whole: bool
) -> DataFrame:
    """Files of one encoding and header, by Spark's reader."""
    rows = _reader(spark, encoding, whole).option("header", True)
    rows = rows.schema(_schema([*header, _SURPLUS])).csv(paths)
    return _fitting(rows, header, encoding, F.col("_metadata.file_path"), _position())


def _parsed(records: Records, paths: list[str], encoding: str, header: tuple[str, ...]) -> DataFrame:
    """Files of one encoding and header, by their records."""
    names = [*header, _SURPLUS]
    options = {"quote": '"', "escape": '"', "nullValue": _ABSENT, "emptyValue": ""}
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records.of(paths).withColumn("row", F.from_csv("record", schema, options))
    cells = [F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)]
    rows = rows.select("path", "at", "own", *cells)
    return _fitting(rows, header, encoding, F.col("path"), F.col("at"), F.col("own"))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None = None,
    with_ordinal: bool = False,
) -> DataFrame:
    """Read a CSV extract with a header, of one file or several with the same columns:
    every column text, null spellings null. ``with_ordinal`` adds ``_ORDINAL``, the
    row's place in the extract."""
    traits, records = _look(spark, path, encoding)
    alike: dict[tuple, list[str]] = {}
    for file in traits:
        alike.setdefault((file.encoding, file.header, file.breaks_in_cells, file.whole), []).append(file.path)
    if not alike:
        # Nothing but empty files.
        empty = F.lit(None).cast("struct<file:string,block:bigint,row:bigint>")
        df = spark.createDataFrame([], _schema([])).select(empty.alias(ORDINAL))
        return df if with_ordinal else df.drop(ORDINAL)
    columns = {frozenset(header) for _, header, _, _ in alike}
    if len(columns) > 1:
        raise ValueError(f"the files of {path} have different columns: {sorted(map(sorted, columns))}")
    whole = union_all([
        _read_alike(spark, paths, own, header, one_task)
        if one_task or not breaks
        else _parsed(records, paths, own, header)
        for (own, header, breaks, one_task), paths in alike.items()
    ])
    df = apply_steps(whole, [n for n in whole.columns if n != ORDINAL], null_if_token)
    return df if with_ordinal else df.drop(ORDINAL)
