"""Repeated rows of wide tables.

To find equal rows all rows must meet their like, and moving whole rows for that is dear
where they are wide. Here each row is stood for by a digest of 128 bits; digests are
counted, summed up before they are moved, whatever the rows' width. Only rows whose digest
occurs more than once can have a like; these, and a few whose digest begins alike, are
compared whole, so that a collision of digests changes nothing. Up to ``SENT_DIGESTS`` repeated
digests are sent to all tasks, so that rows without a like stay where they are; where more than
``MOST_REPEATED`` of all rows have one, whole rows are compared at once.

A table that is written anyway may carry its digests along, see ``with_digest``.

Rows are equal if all their columns are: null equals null, NaN equals NaN and 0.0 equals
-0.0. Tables with maps, or with fractions inside other values, are compared whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from staffline.functions import column
from staffline.session import staged

MOST_REPEATED = 0.25

# Some 50 MB in each executor. Spark's own threshold is lower, and beyond it every wide row
# would be shuffled and sorted to find the few that have a like.
SENT_DIGESTS = 1_000_000

_DIGEST = "_digest"
_UNHASHED = ("map<", "variant", "float", "double")


def row_digest(df: DataFrame) -> Column | None:
    """Equal for equal rows; None if the table has values without a hash of their own."""
    values = []
    for field in df.schema:
        value = column(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            values.append(F.when(F.isnan(value), F.lit(float("nan"))).otherwise(value + 0.0))
        elif any(kind in field.dataType.simpleString() for kind in _UNHASHED):
            return None
        else:
            values.append(value)
    if not values:
        return None
    # A null leaves a hash as it is, so where the nulls are is hashed beside the values.
    nulls = F.concat(*(F.when(v.isNull(), "1").otherwise("0") for v in values))
    return F.struct(*(F.xxhash64(F.lit(seed), nulls, *values).alias(f"d{seed}") for seed in (1, 2)))


def with_digest(df: DataFrame) -> DataFrame:
    """The table with its digests as a last column, to be written with it; as it is if it has
    none. Digests are then not worked out again from all columns each time they are asked for."""
    digest = row_digest(df)
    return df if digest is None else df.withColumn(_DIGEST, digest)


def without_digest(df: DataFrame) -> DataFrame:
    return df.drop(_DIGEST) if _DIGEST in df.columns else df


def repeated_digests(df: DataFrame, digest: Column) -> DataFrame:
    """Digests that several rows have, and how many rows."""
    counts = df.select(digest.alias(_DIGEST)).groupBy(_DIGEST).agg(F.count("*").alias("n"))
    return counts.where("n > 1")


def _with_like(df: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The rows that may have a like, and those that have none; None if that is no help."""
    keyed = df if _DIGEST in df.columns else with_digest(df)
    if _DIGEST not in keyed.columns:
        return None
    repeated = staged(repeated_digests(keyed, F.col(_DIGEST)))
    doubtful, digests = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not doubtful:
        df = without_digest(df)
        return df.limit(0), df
    if doubtful > MOST_REPEATED * df.agg(F.count("*")).first()[0]:
        return None
    # Half a digest will do: rows that begin alike by chance are compared whole as well.
    keyed, keys = keyed.withColumn(_DIGEST, F.col(_DIGEST)["d1"]), repeated.select(F.col(_DIGEST)["d1"].alias(_DIGEST))
    if digests <= SENT_DIGESTS:
        keys = F.broadcast(keys)
    return (
        keyed.join(keys, _DIGEST, "left_semi").drop(_DIGEST),
        keyed.join(keys, _DIGEST, "left_anti").drop(_DIGEST),
    )


def without_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows."""
    split = _with_like(df)
    if split is None:
        return without_digest(df).dropDuplicates()
    doubtful, single = split
    return single.unionByName(doubtful.dropDuplicates())


def duplicate_count(df: DataFrame) -> Column:
    """How many rows have an equal row before them, as a value."""
    split = _with_like(df)
    rows = without_digest(df) if split is None else split[0]
    copies = rows.groupBy(*(column(n) for n in rows.columns)).agg(F.count("*").alias("n"))
    return F.lit(copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]).cast("bigint")
