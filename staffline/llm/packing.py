"""Best-fit packing of documents into sequences by linear grouping.

A document is its token ids and an end id; one longer than a sequence is cut into pieces
of a whole sequence and a last, shorter one. Only the number of pieces of each length
matters for the packing, ``CAPACITY`` counts at most, whatever the number of documents.
From these counts the driver makes a plan:

1. Large lengths are put in order and cut into groups of equal cardinality; each is
   rounded up to the largest length of its group. (``SETTINGS`` has two ways to choose
   what is large and how many groups there are; the plan with fewer sequences is used.)
2. The few sizes that remain are packed by configurations: the linear program over all
   ways to fill a sequence is solved by column generation, with a knapsack for pricing,
   and rounded down.
3. Actual lengths take the places of the rounded ones.
4. What is left, the large ones that rounding left over and all small ones, goes by
   decreasing length to the sequence with the least room that is enough.

The plan is a list of steps: "pieces number k to k + n of length L go to sequences from s
on, c to each, at this offset". Sequences filled alike are handled together, so that the
number of steps depends on the number of lengths and not of documents: a step of the
second kind at least halves the room of the sequences it touches or uses a length up,
which bounds the steps by ``12 * (lengths + configurations * places + 2 * lengths)``.

A piece's number among those of its length is a running count within its task plus the
counts of the tasks before, so no length, however frequent, meets in one task. The plan
is looked up in order, by binary search.

Nulls: a null text is empty and packs as its end id alone; a null doc_id is packed and
stays null. Rows that repeat a doc_id are packed each. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staffline.llm.tokens import encoder, tokenizer_path
from staffline.llm.words import as_bytes
from staffline.session import staged

CAPACITY = 4096
END_ID = 1
#: What counts as large, as a part of a sequence, and the number of groups; all are tried.
SETTINGS = ((1 / 3, 128), (1 / 4, 96))
PRICING_ROUNDS = 3000


@dataclass(frozen=True)
class Step:
    length: int
    first: int
    n: int
    sequence: int
    each: int
    offset: int


def _best_filling(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: its value and counts."""
    best = np.zeros(capacity + 1)
    choices: list[np.ndarray] = []
    for _ in range(capacity // int(sizes.min())):
        new, choice = best.copy(), np.full(capacity + 1, -1)
        for g, (size, value) in enumerate(zip(sizes, worth, strict=True)):
            if value > 0:
                with_it = best[: capacity + 1 - size] + value
                better = with_it > new[size:] + 1e-12
                new[size:][better] = with_it[better]
                choice[size:][better] = g
        choices.append(choice)
        if (choice < 0).all():
            break
        best = new
    counts, room = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if (g := choice[room]) >= 0:
            counts[g] += 1
            room -= sizes[g]
    return float(worth @ counts), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Ways to fill a sequence with the sizes and how often to use each; rounded down, so
    that no demand is exceeded."""
    basis = np.diag((capacity // sizes).astype(float))
    level = demand / np.diag(basis)
    for _ in range(PRICING_ROUNDS):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, filling = _best_filling(sizes, worth, capacity)
        if value <= 1 + 1e-9:
            break
        along = np.linalg.solve(basis, filling)
        ratio = np.where(along > 1e-9, level / np.where(along > 1e-9, along, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(ratio[out], 0.0)
        level = np.maximum(level - step * along, 0)
        level[out] = step
        basis[:, out] = filling
    used = []
    left = demand.astype(np.int64).copy()
    for column, times in zip(basis.T.astype(np.int64), level, strict=True):
        most = min((int(left[g] // column[g]) for g in np.flatnonzero(column)), default=0)
        n = min(int(times + 1e-6), most)
        if n:
            used.append((column, n))
            left -= n * column
    return used


def plan(counts: np.ndarray, capacity: int = CAPACITY, settings=SETTINGS) -> list[Step]:
    """The best plan of all settings."""
    n_sequences = lambda steps: max((s.sequence - (-s.n // s.each) for s in steps), default=0)
    return min((plan_with(counts, capacity, *x) for x in settings), key=n_sequences)


def plan_with(counts: np.ndarray, capacity: int, large: float, groups: int) -> list[Step]:
    """``counts[length]`` pieces of each length from 0 to capacity (none of length 0)."""
    counts = np.asarray(counts, np.int64)
    steps: list[Step] = []
    used = np.zeros(capacity + 1, np.int64)
    n_sequences = 0
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, int]]] = {}

    def open_room(first: int, n: int, room: int) -> None:
        if n and room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((first, n))

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        steps.append(Step(length, int(used[length]), n, sequence, each, offset))
        used[length] += n

    if counts[capacity]:
        put(capacity, int(counts[capacity]), 0, 1, 0)
        n_sequences = int(counts[capacity])

    lengths = np.arange(capacity - 1, int(capacity * large), -1)
    lengths = lengths[counts[lengths] > 0]
    total = int(counts[lengths].sum())
    if total:
        # Runs of equal length in each group, largest first.
        runs: list[list[list[int]]] = []
        bounds = [total * g // groups for g in range(1, groups + 1)]
        done, g = 0, 0
        for length in lengths:
            n = int(counts[length])
            while n:
                while bounds[g] <= done:
                    g += 1
                take = min(n, bounds[g] - done)
                while len(runs) <= g:
                    runs.append([])
                runs[g].append([int(length), take])
                done, n = done + take, n - take
        merged: dict[int, list[list[int]]] = {}
        for group in filter(None, runs):
            merged.setdefault(group[0][0], []).extend(group)
        sizes = np.array(sorted(merged), np.int64)
        demand = np.array([sum(n for _, n in merged[int(s)]) for s in sizes], np.int64)
        for column, times in configurations(sizes, demand, capacity):
            classes = [(n_sequences, times, 0)]
            for g in np.flatnonzero(column)[::-1]:
                for _ in range(column[g]):
                    queue, after = merged[int(sizes[g])], []
                    for first, n, fill in classes:
                        while n:
                            length, there = queue[0]
                            take = min(n, there)
                            put(length, take, first, 1, fill)
                            after.append((first, take, fill + length))
                            first, n = first + take, n - take
                            queue[0][1] -= take
                            if not queue[0][1]:
                                queue.pop(0)
                    classes = after
            for first, n, fill in classes:
                open_room(first, n, capacity - fill)
            n_sequences += times

    for length in range(capacity - 1, 0, -1):
        left = int(counts[length] - used[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                first, n, room = n_sequences, -(-left // each), capacity
                n_sequences += n
            else:
                room = rooms[at]
                first, n = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                each = room // length
            full = min(n, left // each)
            if full:
                put(length, full * each, first, each, capacity - room)
                open_room(first, full, room - each * length)
                left -= full * each
            if full < n and left:
                put(length, left, first + full, left, capacity - room)
                open_room(first + full, 1, room - left * length)
                full, left = full + 1, 0
            open_room(first + full, n - full, room)
    return steps


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, numbered within task and length."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        encode = encoder(path).encode
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = []
            for key, ids in zip(keys, encode(as_bytes(batch.column(1))), strict=True):
                whole = np.concatenate([ids, end]).astype("<u4")
                for number, start in enumerate(range(0, len(whole), capacity)):
                    piece = whole[start : start + capacity]
                    rows.append((key, number, start, len(piece), zlib.crc32(piece.tobytes()), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, path or tokenizer_path(), capacity, end_id))
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[row.length] = row.n
    steps = plan(counts, capacity)
    table = np.array([(s.length, s.first, s.n, s.sequence, s.each, s.offset) for s in steps], np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)  # its size is bounded by the number of lengths

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("earlier"))
    ranked = cut.join(earlier, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("nth")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = shared.value
        # Ranks stay below 2**48.
        keys = (steps[:, 0] << 48) + steps[:, 1]
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame.pop("rank").to_numpy(np.int64)
            at = steps[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - at[:, 1]
            frame["sequence_id"] = at[:, 3] + nth // at[:, 4]
            frame["offset"] = at[:, 5] + nth % at[:, 4] * length
            yield frame

    return ranked.mapInPandas(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
