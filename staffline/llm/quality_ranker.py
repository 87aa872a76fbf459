"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its whole text; of a good and a bad
document the good one is preferred with probability ``sigmoid(strength difference)``. The
weights come from preference pairs of labelled documents, by logistic loss on the
differences of their features, with Newton steps on the sums over all pairs. A threshold
is then set at the quantile of the strengths that the share of bad documents in the sample
gives, and the score is a logistic function of the strength that is ``CUT`` there.

Fitting uses a sample of at most ``SAMPLE`` labelled documents, those with the smallest
hashes of their ids, and ``PAIRS`` pairs; only this sample's features reach the driver.
Scoring runs over all documents in one pass without a shuffle and uses the text alone.

Nulls: null, empty and blank texts have all features zero and get the score of such a
text. Labels that are null, of unknown documents or null ids are ignored. Repeated rows
are scored each. Without labels of both kinds, all scores are 0.5. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.quality_rules import count_words
from staffline.llm.words import Words, as_bytes, buffers

SAMPLE = 20_000
PAIRS = 100_000
CUT = 0.3
RIDGE = 1e-3
NEWTON_STEPS = 25
SEED = 7

_CLASSES = ("other", "lower", "upper", "digit", "space", "line_end", "stop", "mark", "symbol", "wide")
_CLASS = np.zeros(256, np.int64)
for _name, _bytes in {
    "lower": range(ord("a"), ord("z") + 1), "upper": range(ord("A"), ord("Z") + 1), "digit": range(ord("0"), ord("9") + 1),
    "space": [0x20, *range(0x09, 0x0E)], "stop": b".,;:", "mark": b"!?", "symbol": b"#*$%&|<>@^~_=+\\/{}[]`", "wide": range(0x80, 0x100),
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
_CLASS[0x0A] = _CLASSES.index("line_end")

FEATURES = (
    "log_words", "word_length", "repeat", "dup_lines", "words_per_line", "upper", "digit", "stop", "mark", "symbol", "wide", "other", "short",
)


def features(words: Words) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a buffer."""
    n_words, chars, _, dup_lines, repeats, lines = (c.astype(float) for c in count_words(words))
    ends = np.append(words.starts[1:] - 1, len(words.buffer))
    doc = np.repeat(np.arange(words.n_docs), ends - words.starts + 1)[: len(words.buffer)]
    counts = np.bincount(doc * len(_CLASSES) + _CLASS[words.buffer], minlength=words.n_docs * len(_CLASSES))
    by_class = dict(zip(_CLASSES, counts.reshape(-1, len(_CLASSES)).T.astype(float), strict=True))
    size = np.maximum(chars, 1)
    per = lambda a, b: a / np.maximum(b, 1)
    # Square roots keep small shares apart and large ones within bounds.
    out = np.column_stack([
        np.log1p(n_words), np.minimum(per(chars, n_words), 20) / 10, np.sqrt(per(repeats, n_words)), np.sqrt(per(dup_lines, lines)),
        np.log1p(per(n_words, lines)), *(np.sqrt(np.minimum(by_class[c] / size, 1)) for c in ("upper", "digit", "stop", "mark", "symbol", "wide", "other")),
        (n_words < 50).astype(float),
    ])
    out[n_words == 0] = 0
    return out


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        shift = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights - self.threshold + shift, -60, 60)))


def fit(rows: np.ndarray, good: np.ndarray, n_pairs: int = PAIRS, seed: int = SEED) -> Ranker:
    """Weights and threshold from the features of labelled documents."""
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return Ranker(np.zeros(rows.shape[1]), np.log(CUT / (1 - CUT)))
    spread = rows.std(axis=0)
    scale = np.where(spread > 1e-9, spread, 1)
    rng = np.random.default_rng(seed)
    x = (rows[rng.choice(better, n_pairs)] - rows[rng.choice(worse, n_pairs)]) / scale
    w = np.zeros(rows.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (1 - p) / len(x) - RIDGE * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    weights = w / scale
    strength = rows @ weights
    return Ranker(weights, _cut(strength, good))


def _cut(strength: np.ndarray, good: np.ndarray) -> float:
    """The strengths' quantile at the share of bad documents, in the middle between the
    strengths on its two sides."""
    ranked = np.sort(strength)
    at = min(int(round((good == 0).mean() * len(ranked))), len(ranked) - 1)
    return float((ranked[max(at - 1, 0)] + ranked[at]) / 2)


def _rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and the features of ``text``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema), "x array<double>"])

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(len(keep)))
            x = np.zeros((len(texts), len(FEATURES)))
            for part, words in buffers(texts):
                x[part] = features(words)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column) -> Ranker:
    """``allowed``: which labels may be learnt from, a condition on doc_id."""
    known = labels.where(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_good"))
    known = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE rows at most.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # Of rows that repeat an id, the one with the smallest features.
    rows = _rows(sample, ["doc_id", "_good"]).groupBy("doc_id", "_good").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["_good"].to_numpy())


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """Per row: doc_id and score."""

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            score = np.zeros(len(texts))
            for part, words in buffers(texts):
                score[part] = ranker.scores(features(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
