"""Processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from staffline.functions import column
from staffline.operators.history import ORDINAL


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a processed table, replacing an earlier one; Parquet unless asked for
    CSV. The reading order column stays behind. Returns the path."""
    out = df.drop(ORDINAL)
    if fmt == "parquet":
        out.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        flat = out.select(
            *(
                F.array_join(column(f.name), ",").alias(f.name)
                if isinstance(f.dataType, T.ArrayType)
                else column(f.name).alias(f.name)
                for f in out.schema
            )
        )
        writer = flat.write.mode("overwrite").option("header", True).option("escape", '"')
        writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return path
