"""Ordered histories: rows of many entities, each entity's rows in order.

Most entities have few rows, so one hash exchange on the entity and plain windows
do. An entity with more than ``hot_rows`` rows would sit in one task; such hot
entities are range-partitioned over their own order instead, so that one entity
spreads over many chunks, and every running value is computed per chunk and
completed with a carry from the chunks before it. There are as many chunks as tasks
are wanted, and more only where a chunk would exceed ``CHUNK_ROWS``: a chunk may hold
many hot entities, so a low ``hot_rows`` makes no more of them. A carry has one row per
hot entity and chunk it touches, so at most (hot entities + chunks) rows. Carries are
written out as they are made: the rows they complete would otherwise be planned twice
for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from staffline.session import staged

HOT_ROWS = 1_000_000

# Rows of a chunk at most, on average; fewer if that leaves tasks without work.
CHUNK_ROWS = 1_000_000

# A row's place in the file it was read from, when the source kept it.
ORDINAL = "_ORDINAL"

_CHUNK = "_chunk"
_TIE = "_tie"


@dataclass(frozen=True)
class OrderedHistory:
    """Rows with their entity key and order. ``chunk`` names the chunk column when
    an entity's rows are spread over several chunks."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]
    chunk: str | None = None

    @property
    def _group(self) -> list[str]:
        return [self.key] if self.chunk is None else [self.key, self.chunk]

    @property
    def _ordered(self) -> WindowSpec:
        return Window.partitionBy(*self._group).orderBy(*self.order)

    def position(self) -> Column:
        return F.struct(*self.order)

    def with_column(self, name: str, value: Column) -> OrderedHistory:
        return replace(self, rows=self.rows.withColumn(name, value))

    def max_before(self, name: str, value: Column) -> OrderedHistory:
        """The largest value over an entity's earlier rows; null on its first."""
        earlier = self._ordered.rowsBetween(Window.unboundedPreceding, -1)
        local = F.max(value).over(earlier)
        if self.chunk is None:
            return self.with_column(name, local)
        carried = self._with_carry(F.max(value), F.max("_total"))
        return replace(
            self,
            rows=carried.withColumn(name, F.greatest("_carry", local)).drop("_carry"),
        )

    def running_sum(self, name: str, value: Column) -> OrderedHistory:
        """The sum of a non-null value over an entity's rows so far, this one included."""
        so_far = self._ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = F.sum(value).over(so_far)
        if self.chunk is None:
            return self.with_column(name, local)
        carried = self._with_carry(F.sum(value), F.sum("_total"))
        total = local + F.coalesce("_carry", F.lit(0))
        return replace(self, rows=carried.withColumn(name, total).drop("_carry"))

    def last_before(self, name: str, value: Column) -> OrderedHistory:
        """The most recent non-null value on an entity's earlier rows."""
        earlier = self._ordered.rowsBetween(Window.unboundedPreceding, -1)
        local = F.last(value, ignorenulls=True).over(earlier)
        if self.chunk is None:
            return self.with_column(name, local)
        latest = F.max_by(value, F.when(value.isNotNull(), self.position()))
        carried = self._with_carry(latest, F.last("_total", ignorenulls=True))
        return replace(
            self,
            rows=carried.withColumn(name, F.coalesce(local, "_carry")).drop("_carry"),
        )

    def _with_carry(self, per_chunk: Column, over_chunks: Column) -> DataFrame:
        earlier = (
            Window.partitionBy(self.key)
            .orderBy(self.chunk)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        totals = self.rows.groupBy(*self._group).agg(per_chunk.alias("_total"))
        carry = totals.select(*self._group, over_chunks.over(earlier).alias("_carry"))
        # Read from a written table, whose size Spark knows when it chooses the join.
        return self.rows.join(staged(carry.where("_carry IS NOT NULL")), self._group, "left")


def chunk_count(hot_total: int, hot_rows: int, tasks: int) -> int:
    """How many chunks the rows of hot entities make: one for every ``hot_rows`` rows, but
    no more than there are tasks, unless chunks would then exceed ``CHUNK_ROWS``."""
    return min(hot_total // hot_rows, max(tasks - 1, hot_total // CHUNK_ROWS)) + 1


def ordered_histories(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> list[OrderedHistory]:
    """Split rows into ordered histories: one for the entities a task can hold and,
    only when there are any, one for the hot ones. Keys must not be null.

    One pass counts rows per key, summed up before they are shuffled. ``None`` skips it,
    for callers who know that no entity is hot."""
    plain = OrderedHistory(rows, key, tuple(order))
    if hot_rows is None:
        return [plain]
    counts = rows.groupBy(key).count()
    hot_count = F.when(F.col("count") > hot_rows, F.col("count"))
    entities, hot_total = counts.agg(F.count(hot_count), F.sum(hot_count)).first()
    if not entities:
        return [plain]

    keys = staged(counts.where(F.col("count") > hot_rows).select(key))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunk_count(hot_total, hot_rows, tasks)
    chunked_order = (*order, _TIE)
    # Numbered from a written copy: a task run again must number its rows alike.
    chunks = staged(
        staged(rows.join(keys, key, "left_semi"))
        .withColumn(_TIE, F.monotonically_increasing_id())
        .repartitionByRange(spread, key, *chunked_order)
        .withColumn(_CHUNK, F.spark_partition_id())
    )
    return [
        replace(plain, rows=rows.join(keys, key, "left_anti")),
        OrderedHistory(chunks, key, chunked_order, _CHUNK),
    ]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
