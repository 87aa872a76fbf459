"""Quality rules whose cut-offs follow the data.

Every document gets a few whole counts (``COUNTS``) and from them three shares in parts
per ten thousand (``SHARES``). Fixed rules fail very short and very repetitive texts. For
the others a cut-off per language and source replaces fixed numbers: the distribution of
each share is summed up in a mergeable quantile sketch, a histogram that keeps the six
leading bits of each value (relative error below 1/32, at most a few hundred cells, merged
by adding counts), and the cut-off is the median plus ``FENCE`` times the distance from
there to an upper percentile (``UPPER``). Where all values of a group are nearly alike that
distance is taken to be ``LEAST``, so that a clean source does not reject its second-cleanest
rows. A document beyond a cut-off of its own language and source is rejected.

The sketch is built by a partial aggregation, so that a source with a third of all rows
moves no more than its cells; the cut-offs are one row per language and source and are
joined to the documents, by broadcast where Spark finds them small.

Nulls: a null text has no words and fails; null languages and sources form groups of their
own. Empty tables give empty results. Other columns are passed on untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.words import Words, as_bytes, buffers, mix

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SHARES = ("symbol_share", "dup_line_share", "repeat_share")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: Cut-off: median + FENCE * (UPPER percentile - median, LEAST at least); parts per 10,000.
#: Symbols and repeated lines come from few sources' junk, which a higher percentile would
#: take for the source's own; repeated words are spread over all texts.
MEDIAN, FENCE = 50, 20
UPPER = {"symbol_share": 75, "dup_line_share": 75, "repeat_share": 90}
LEAST = {"symbol_share": 20, "dup_line_share": 150, "repeat_share": 120}
#: Leading bits that a cell of the sketch keeps.
SKETCH_BITS = 6


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how often it is there, and whether this is its first place."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    times, first = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    times[order] = np.bincount(group, minlength=1)[group] if len(keys) else 0
    first[order] = new
    return times, first


def count_words(words: Words) -> list[np.ndarray]:
    """``COUNTS`` of each text of a buffer."""
    salt = mix(np.arange(words.n_docs, dtype=np.uint64) + np.uint64(1))
    doc = words.doc
    chars = np.zeros(len(words.buffer) + 1, np.int64)
    np.cumsum((words.buffer & 0xC0) != 0x80, out=chars[1:])
    symbols = np.flatnonzero(SYMBOLS[words.buffer])

    ends = np.append(np.flatnonzero(words.buffer == 10), len(words.buffer))
    lines = np.unique(np.searchsorted(ends, words.start)) if len(doc) else np.zeros(0, np.int64)
    begin = np.where(lines > 0, ends[lines - 1] + 1, 0)
    of = np.searchsorted(words.starts, begin, "right") - 1
    _, first_line = _distinct(words.hash_spans(begin, ends[lines]) ^ salt[of])

    keys, first = words.windows(WINDOW)
    times, _ = _distinct(keys ^ salt[doc[first]])
    repeated = np.zeros(len(doc), bool)
    for step in range(WINDOW):
        repeated[first[times > 1] + step] = True
    return [
        words.per_doc(doc),
        words.per_doc(doc, chars[words.end] - chars[words.start]),
        words.per_doc(np.searchsorted(words.starts, symbols, "right") - 1),
        words.per_doc(of[~first_line]),
        words.per_doc(doc[repeated]),
        words.per_doc(of),
    ]


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """The documents with ``COUNTS`` added, under names that start with ``prefix``."""
    fields = [T.StructField(prefix + c, T.LongType(), False) for c in COUNTS]

    def count(batches):
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
            counts = np.zeros((len(COUNTS), len(texts)), np.int64)
            for part, words in buffers(texts):
                counts[:, part] = count_words(words)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, counts)], names=[*batch.schema.names, *(f.name for f in fields)]
            )

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, *fields]))


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def shares(prefix: str = "") -> dict[str, Column]:
    """Each share as a whole number of parts per ten thousand; rows need words."""
    c = {x: F.col(prefix + x) for x in COUNTS}
    part = lambda a, b: F.floor(10_000 * a / F.greatest(b, F.lit(1))).cast("long")
    return {
        "symbol_share": part(c["n_symbols"], c["word_chars"]),
        "dup_line_share": part(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": part(c["n_repeat_words"], c["n_words"]),
    }


def cell(value: Column) -> Column:
    """The sketch's cell of a whole number: its leading bits, the others zero."""
    low_bits = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return value - value % F.pow(F.lit(2), low_bits).cast("long")


def cutoffs(counted: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """One row per language and source: the highest value allowed of each share.

    ``counted`` holds documents with counts; those failing the fixed rules are left out."""
    long = counted.where(~base_failed(prefix)).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.posexplode(F.array(*[cell(x) for x in shares(prefix).values()])).alias("share", "cell"),
    )
    cells = long.groupBy("lang", "source", "share", "cell").agg(F.count("*").alias("n"))
    whole = ["lang", "source", "share"]
    by_cell = F.sort_array(F.collect_list(F.struct("cell", "n")))
    sketches = cells.groupBy(*whole).agg(by_cell.alias("cells"), F.sum("n").alias("total"))

    def at(percent: Column) -> Column:
        """Smallest cell with at least this share of the rows at or below it."""
        found = F.aggregate(
            "cells",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("hit")),
            lambda acc, x: F.struct(
                (acc.seen + x.n).alias("seen"),
                F.coalesce(acc.hit, F.when(100 * (acc.seen + x.n) >= percent * F.col("total"), x.cell)).alias("hit"),
            ),
        )
        return found.hit

    of_share = lambda values: F.get(F.array(*[F.lit(values[s]) for s in SHARES]), F.col("share"))
    middle = at(F.lit(MEDIAN))
    fence = middle + FENCE * F.greatest(at(of_share(UPPER)) - middle, of_share(LEAST))
    fenced = sketches.select(*whole, fence.alias("fence"))
    return fenced.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("share") == i, F.col("fence"))).alias(f"max_{name}") for i, name in enumerate(SHARES)
    ])


def judged(counted: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept`` added, under the prefix."""
    limits = limits.select([F.col(c).alias(f"_limit_{c}") for c in limits.columns])
    joined = counted.join(
        limits,
        F.col(lang).eqNullSafe(F.col("_limit_lang")) & F.col(source).eqNullSafe(F.col("_limit_source")),
        "left",
    )
    within = F.lit(True)
    for name, value in shares(prefix).items():
        # A group without cut-offs has no rows that pass the fixed rules.
        within = within & F.coalesce(value <= F.col(f"_limit_max_{name}"), F.lit(True))
    return joined.select(
        *[F.col(c) for c in counted.columns],
        base_failed(prefix).alias(f"{prefix}base_failed"), (~base_failed(prefix) & within).alias(f"{prefix}kept"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only.

    Counts are made twice, once for the cut-offs and once beside the text; this costs
    less than a shuffle of the texts."""
    prefix = "_rules_"
    limits = cutoffs(with_counts(docs.select("lang", "source", "text"), prefix=prefix), prefix=prefix)
    return judged(with_counts(docs, prefix=prefix), limits, prefix=prefix).where(f"{prefix}kept").select(docs.columns)
