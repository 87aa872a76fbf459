"""How filters that run in a row take each other's rows.

Each document either passes or fails each of some filters, so a text is one of few
patterns: a mask with a bit for each filter that it fails. Documents are counted by part
and mask, with the good and the toxic ones among them; at most 32 cells of a part are left,
however many documents there are.

What survives a set of filters is found for all 32 sets by a walk in Gray-code order: from
one set to the next a single filter is switched on or off. Every cell keeps a count of the
active filters that it fails; a switch changes the counts of the cells with that bit, and
the cells that reach or leave zero change the running survivors. The survivors of all sets
are stored, and any order of filters is read off from them: a step is the difference of two
sets, and a filter's Shapley sum is a weighted sum of such differences.

The five filters of ``FILTERS`` look at whole texts. Four depend on the text alone; the
fifth, a copy of a text with a smaller id, on all rows: rows are first counted by text
(its SHA-256), part and labels, with the smallest id of each group and the rows it has, and
the smallest over the few groups of a text tells which rows are the first. A text with very
many copies is summed up before it is moved; texts themselves are never moved.

Nulls: a null text is empty. A null part is the empty string, like an empty one. A row
without an id has no smaller id, is nobody's original and has no labels. Rows that repeat an
id are documents of their own, none of them a copy by reason of the others. A document is
good (toxic) if any label row of its id says so. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staffline.llm.words import Words, as_bytes, buffers, mix
from staffline.session import staged

FILTERS = "ABCDE"
SHORT_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True


def text_masks(words: Words) -> np.ndarray:
    """For each text of a buffer the bits of the filters A to D that it fails: too short,
    too few different words, too many capitals, a symbol."""
    n_words = words.per_doc(words.doc)
    salt = mix(np.arange(words.n_docs, dtype=np.uint64) + np.uint64(1))
    _, first = np.unique(words.hashes ^ salt[words.doc], return_index=True)
    distinct = words.per_doc(words.doc[first])
    of = lambda places: np.searchsorted(words.starts, places, "right") - 1
    ends = np.append(words.starts[1:] - 1, len(words.buffer))
    points = np.zeros(len(words.buffer) + 1, np.int64)
    np.cumsum((words.buffer & 0xC0) != 0x80, out=points[1:])
    n_points = points[ends] - points[words.starts]
    capitals = words.per_doc(of(np.flatnonzero(_CAPITAL[words.buffer])))
    symbols = words.per_doc(of(np.flatnonzero(_SYMBOL[words.buffer])))
    fails = (
        n_words < SHORT_WORDS,
        100 * distinct < DISTINCT_PERCENT * n_words,
        100 * capitals > CAPITAL_PERCENT * n_points,
        symbols > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def with_masks(docs: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """Per row: id, part, digest of the text and its bits of the filters A to D."""

    def judge(batches):
        for batch in batches:
            texts = as_bytes(batch.column(3))
            masks = np.zeros(len(texts), np.int32)
            for at, words in buffers(texts):
                masks[at] = text_masks(words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(masks)], names=["id", "part", "digest", "mask"])

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)).alias("digest"), whole.alias("text"))
    return rows.mapInArrow(judge, "id bigint, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """Rows per part and mask: ``part``, ``mask``, ``n``, ``good``, ``toxic``."""
    # Equal rows first fold together, wherever they are.
    rows = staged(with_masks(docs, key, part, text).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    said = lambda name: F.coalesce(F.bool_or(F.col(name) == 1), F.lit(False)).alias(name)
    of_id = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(said("quality"), said("toxic"))
    known = of_id.where("quality or toxic")
    labelled = rows.where("id is not null").join(known, "id", "left")
    # Rows without an id would all be sent to one task by a join.
    nobody = rows.where("id is null").withColumns({"quality": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean")})
    both = labelled.unionByName(nobody).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})

    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = both.groupBy("digest", "mask", "part", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nobody"), first.alias("first"))
    # A text's groups: at most four for each part.
    original = F.min("first.id").over(Window.partitionBy("digest"))
    own = F.when(F.col("first.id") == F.col("original"), F.col("first.n")).otherwise(0)
    judged = groups.withColumn("original", original).withColumn("kept", F.col("nobody") + F.coalesce(own, F.lit(0)))
    copy_bit = 1 << FILTERS.index("E")
    split = judged.select("part", "quality", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), F.col("kept").alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))))
    counted = lambda name: F.coalesce(F.sum(F.when(F.col(name), F.col("n"))), F.lit(0)).alias(name)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("quality").alias("good"), counted("toxic"))


@dataclass
class Survivors:
    """What survives each set of active filters: rows, good and toxic ones, by set."""

    states: np.ndarray

    def removed(self, before: int, bit: int) -> np.ndarray:
        return self.states[before] - self.states[before | bit]


def walk(masks: np.ndarray, counts: np.ndarray, n_filters: int = len(FILTERS)) -> Survivors:
    """All sets in Gray-code order, one switch at a time. ``counts``: a row for each mask."""
    failing = np.zeros(len(masks), np.int64)
    survivors = counts.sum(axis=0)
    states = np.zeros((1 << n_filters, counts.shape[1]), np.int64)
    states[0] = survivors
    active = 0
    for step in range(1, 1 << n_filters):
        bit = step & -step  # the bit in which neighbouring Gray codes differ
        active ^= bit
        touched = (masks & bit) != 0
        if active & bit:
            survivors = survivors - counts[touched & (failing == 0)].sum(axis=0)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            survivors = survivors + counts[touched & (failing == 0)].sum(axis=0)
        states[active] = survivors
    return Survivors(states)


def shapley_sums(found: Survivors, n_filters: int = len(FILTERS)) -> list[int]:
    """For each filter the rows it removes, summed over all orders."""
    out = []
    for f in range(n_filters):
        total = 0
        for before in range(1 << n_filters):
            if not before >> f & 1:
                size = before.bit_count()
                orders = factorial(size) * factorial(n_filters - 1 - size)
                total += orders * int(found.removed(before, 1 << f)[0])
        out.append(total)
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COLUMNS)


def steps_of(part: str, found: Survivors) -> pd.DataFrame:
    """One row for every order of the filters and every step of it."""
    whole, sums = (1 << len(FILTERS)) - 1, shapley_sums(found)
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, active = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            removed, good, toxic = (int(x) for x in found.removed(active, bit))
            active |= bit
            rows.append((
                part, name, step, int(found.states[active][0]), removed, int(found.removed(0, bit)[0]) - removed,
                int(found.removed(whole ^ bit, bit)[0]), good, toxic, sums[f]))
    return pd.DataFrame(rows, columns=["part", "filter_order", "step", *COLUMNS]).astype({"step": "int32"})


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """For each part, every order of the filters and each step: rows kept so far, removed
    here, failing but gone before, failing this filter alone, good and toxic ones removed
    here, and the filter's Shapley sum."""

    def run(group: pd.DataFrame) -> pd.DataFrame:  # at most 32 rows
        found = walk(group["mask"].to_numpy(np.int64), group[["n", "good", "toxic"]].to_numpy(np.int64))
        return steps_of(group["part"].iloc[0], found)

    return staged(cells(docs, labels, key, part, text)).groupBy("part").applyInPandas(run, _SCHEMA)
