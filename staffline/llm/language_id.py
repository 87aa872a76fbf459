"""Language by multinomial naive Bayes over hashed character n-grams.

A text's n-grams are the runs of ``SIZES`` neighbouring characters inside its words, lower-
cased, each word between two edge marks; a word is a run of letters and combining marks,
so digits, punctuation and line ends play no part. An n-gram is known by its hash into
some thousand buckets.

Learning sums bucket counts per language over all allowed rows, in one pass: a task sends on
one count for each language and bucket that it has met, and Spark adds these up, so what is
learnt does not depend on how rows are dealt. The model is a matrix of log-probabilities,
languages by buckets, of ``MODEL_BYTES`` at most: the number of buckets, ``MAX_BUCKETS`` with
few languages, is halved until the matrix fits. It is broadcast, and a batch of texts is
scored in numpy by adding up the matrix rows of each text's n-grams. Log-probabilities are
whole multiples of 2**-20, so sums are exact and do not depend on the order of rows.

The prediction is the language of the highest posterior, the smaller name where two are
equal; the score is that posterior, with priors from the numbers of documents.

Nulls: a text that is null or has no letter is ``UNKNOWN``, with score 0; such rows teach
nothing but the prior of their language. Rows with a null language are not learnt from; the
empty string is a language like any other. Without a language learnt, everything is
``UNKNOWN``. Repeated rows are counted and predicted each. Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.words import mix

UNKNOWN = "und"
SIZES = (1, 2, 3, 4)
MAX_BUCKETS, MIN_BUCKETS = 1 << 15, 1 << 8
MODEL_BYTES = 64 << 20
SMOOTHING = 0.1
#: Log-probabilities are kept in these units.
UNIT = 2.0**-20
#: Characters handled at a time.
BUFFER_CHARS = 1 << 18

_EDGE = np.uint32(ord(" "))


@cache
def _kinds() -> np.ndarray:
    """For each code point: 2 a letter, 1 a combining mark, 0 anything else."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.int8)


def _normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' characters, lower-cased, every run of others one edge mark, an edge mark
    before and after each text; the text of each character; the letters of each text."""
    lowered = [t.lower() for t in texts]
    whole = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    doc = np.append(doc[:1], doc)  # the edge mark before the first text
    kind = _kinds()[whole]
    inside = kind > 0
    keep = inside.copy()
    keep[0] = True
    keep[1:] |= inside[:-1]  # of a run of other characters the first stays
    chars = np.where(inside, whole, _EDGE)[keep]
    return chars, doc[keep], np.bincount(doc[kind == 2], minlength=len(texts))


def grams(texts: list[str], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each size the bucket and the text of every n-gram, in order; each text's letters."""
    chars, doc, letters = _normal(texts)
    inner = chars != _EDGE
    out = []
    key = np.zeros(len(chars), np.uint64)
    whole = np.ones(len(chars), bool)
    for size in range(1, max(SIZES) + 1):
        # A gram may begin or end with an edge mark but not reach over one.
        n = len(chars) - size + 1
        if n <= 0:
            break
        key = key[:n] * np.uint64(0x9E3779B97F4A7C15)
        key += chars[size - 1 :]
        whole = whole[:n] & inner[size - 2 : size - 2 + n] if size > 2 else whole[:n]
        if size in SIZES:
            here = np.flatnonzero(whole if size > 2 else inner[:n] | inner[size - 1 :])
            bucket = (mix(key[here] + np.uint64(size)) & np.uint64(buckets - 1)).astype(np.int32)
            # The edge mark before a text belongs to the text before it.
            out.append((bucket, doc[here + (size > 1)]))
    return out, letters


def _parts(texts: list[str]):
    """Slices of a batch of about ``BUFFER_CHARS`` characters, a text at least."""
    at = 0
    while at < len(texts):
        until, size = at, 0
        while until < len(texts) and (until == at or size + len(texts[until]) < BUFFER_CHARS):
            size += len(texts[until]) + 1
            until += 1
        yield slice(at, until)
        at = until


@dataclass(frozen=True)
class Model:
    """``matrix``: a row for each language, a column for each bucket, in ``UNIT``."""

    languages: tuple[str, ...]
    prior: np.ndarray
    matrix: np.ndarray

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text and language, in ``UNIT``, and each text's letters."""
        total = np.repeat(self.prior[None, :], len(texts), axis=0)
        letters = np.zeros(len(texts), np.int64)
        for part in _parts(texts):
            found, letters[part] = grams(texts[part], self.matrix.shape[1])
            for bucket, doc in found:
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
                of = part.start + doc[first]
                for i, row in enumerate(self.matrix if len(first) else ()):
                    total[of, i] += np.add.reduceat(row.take(bucket), first)
        return total, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, letters = self.likelihoods(texts)
        best = total.argmax(axis=1)
        behind = (total - total.max(axis=1, keepdims=True)) * UNIT
        score = np.where(letters > 0, 1 / np.exp(behind).sum(axis=1), 0.0)
        return [self.languages[i] if n else UNKNOWN for i, n in zip(best, letters, strict=True)], score


def fit(languages: list[str], documents: np.ndarray, counts: np.ndarray) -> Model:
    """``counts``: languages by buckets."""
    smooth = counts + SMOOTHING
    matrix = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))
    prior = np.log(documents / documents.sum())
    return Model(tuple(languages), np.rint(prior / UNIT).astype(np.int64), np.rint(matrix / UNIT).astype(np.int64))


def buckets_for(n_languages: int) -> int:
    buckets = MAX_BUCKETS
    while buckets > MIN_BUCKETS and 8 * buckets * n_languages > MODEL_BYTES:
        buckets //= 2
    if 8 * buckets * n_languages > MODEL_BYTES:
        raise ValueError(f"{n_languages} languages do not fit a model of {MODEL_BYTES} bytes")
    return buckets


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """Per task: the count of each language and bucket met. ``docs``: lang, text."""

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for part in _parts(texts):
                own, code = np.unique(names[part].astype(str), return_inverse=True)
                start = (code * buckets).astype(np.int64)
                sums = np.zeros(len(own) * buckets, np.int64)
                for bucket, doc in grams(texts[part], buckets)[0]:
                    sums += np.bincount(start[doc] + bucket, minlength=len(sums))
                for name, row in zip(own, sums.reshape(-1, buckets), strict=True):
                    tables[str(name)] = tables.get(str(name), 0) + row
        for name, row in tables.items():
            met = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(row[met], pa.int64())],
                names=["lang", "bucket", "n"])

    return docs.mapInArrow(count, "lang string, bucket int, n bigint")


def train(docs: DataFrame, allowed: Column, text: str = "text", lang: str = "lang") -> Model:
    """``allowed``: which rows may be learnt from; a null condition means not."""
    known = docs.where(allowed & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # A row for each language, and a row for each cell of the bounded matrix.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).toPandas().sort_values("lang")
    languages = sizes["lang"].tolist()
    if not languages:
        return Model((), np.zeros(0, np.int64), np.zeros((0, MIN_BUCKETS), np.int64))
    buckets = buckets_for(len(languages))
    cells = _counted(known, buckets).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), buckets), np.int64)
    at = {name: i for i, name in enumerate(languages)}
    counts[cells["lang"].map(at).to_numpy(np.int64), cells["bucket"].to_numpy(np.int64)] = cells["n"]
    return fit(languages, sizes["n"].to_numpy(float), counts)


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key as ``doc_id``, ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES and the names

    def run(batches):
        for batch in batches:
            names, score = shared.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
