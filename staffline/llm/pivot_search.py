"""Exact top-k inner products by elimination with a pivot table.

Vectors are turned into whole numbers, ``floor(scale * x)``. The pivot table holds each
vector's distances to ``PIVOTS`` pivots, chosen far apart from a sample of at most
``PIVOT_SAMPLE`` vectors (any pivots give right results). For a query q and a candidate x
the distance is at least the largest difference of their distances to a pivot, so

    <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2

is at most the same with that lower bound for d. Candidates are evaluated in the order of
these bounds, a growing slice at a time, until the next bound is below the k-th best score
found: what follows can neither enter nor tie.

Candidates are dealt to shards by a hash of their id, queries to blocks; each task gets one
shard and one block, both of bounded size, and returns k rows for each query at most.
These are merged by a window per query, k rows a shard. The queries are a given set, and
the work is queries times vectors at worst, in blocks; no pair leaves a task unless it is
among its shard's best.

Nulls: vectors that are null or hold a null, NaN or infinite component take no part, nor
do rows without id. Vectors of different lengths are filled up with zeros. Rows that
repeat an id each count as candidates; none is a candidate for a query of its own id.
Ties go to the smaller id. Fewer than k candidates give fewer rows; empty tables none.
Scores are exact as long as they fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffline.session import staged

K = 10
SCALE = 1024
PIVOTS = 32
PIVOT_SAMPLE = 1024
LEAST_SHARD, MOST_SHARD, SHARDS_WANTED = 4096, 65_536, 48
QUERY_BLOCK = 2048
#: Queries whose bounds are made at once, and candidates evaluated first.
AT_ONCE, FIRST_SLICE = 32, 128


def whole_vectors(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return table.where(usable).select(
        F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def stacked(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those chosen before."""
    points = sample.astype(np.float64)
    chosen: list[int] = []
    nearest = np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        at = int(np.argmax(nearest)) if chosen else 0
        chosen.append(at)
        nearest = np.minimum(nearest, ((points - points[at]) ** 2).sum(axis=1))
    return points[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    points = vectors.astype(np.float64)
    out = np.empty((len(points), len(pivots)))
    for at, pivot in enumerate(pivots):
        out[:, at] = np.sqrt(((points - pivot) ** 2).sum(axis=1))
    return out


def best_of_shard(q: np.ndarray, q_id: np.ndarray, q_far: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_far: np.ndarray, k: int):
    """Rows (query id, id, score) of the k best for each query, and the number evaluated."""
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    kind = np.float64 if largest < 2**53 else np.int64
    q, x = q.astype(kind), x.astype(kind)
    q_norm, x_norm = ((v.astype(np.float64) ** 2).sum(axis=1) for v in (q, x))
    rows, evaluated = [], 0
    for at in range(0, len(q), AT_ONCE):
        block = slice(at, at + AT_ONCE)
        low = np.zeros((len(q[block]), len(x)))
        for p in range(x_far.shape[1]):
            np.maximum(low, np.abs(q_far[block, p, None] - x_far[None, :, p]), out=low)
        norms = q_norm[block, None] + x_norm[None, :]
        # Rounding of the distances can make a bound too tight by far less than this.
        bound = (norms - low**2) / 2 + 1e-9 * norms + 1e-6
        for row in range(len(bound)):
            order = np.argsort(-bound[row])
            ranked, query = bound[row][order], at + row
            best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
            done, step = 0, FIRST_SLICE
            while done < len(order) and not (len(best_id) == k and ranked[done] < best_score[-1]):
                part = order[done : done + step]
                part_id = x_id[part]
                score = (x[part] @ q[query]).astype(np.int64)
                other = part_id != q_id[query]
                best_score = np.concatenate([best_score, score[other]])
                best_id = np.concatenate([best_id, part_id[other]])
                top = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[top], best_id[top]
                done, step = done + len(part), step * 2
            evaluated += done
            rows += zip([q_id[query]] * len(best_id), best_id, best_score, strict=True)
    return rows, evaluated


def top_k(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """``is_query`` is a condition on ``id``. Returns query_id, rank, vec_id, score."""
    plain = whole_vectors(table, key, vector, scale)
    facts = plain.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = facts.width or 0
    sample = plain.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).toPandas()
    pivots = choose_pivots(stacked(sample["v"], width), PIVOTS)
    shard_rows = max(LEAST_SHARD, min(MOST_SHARD, facts.n // SHARDS_WANTED))
    n_shards, n_blocks = max(1, -(-facts.n // shard_rows)), max(1, -(-facts.q // QUERY_BLOCK))

    def measure(frames):
        for frame in frames:
            far = distances(stacked(frame["v"], width), pivots)
            yield frame.assign(far=list(far))

    measured = staged(plain.mapInPandas(measure, "id bigint, v array<bigint>, far array<double>"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vectors = measured.select("*", dealt(n_shards).alias("shard"), every(n_blocks).alias("block"))
    queries = measured.where(is_query).select("*", dealt(n_blocks).alias("block"), every(n_shards).alias("shard"))

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(x) and len(q):
            table_of = lambda f: (stacked(f["v"], width), f["id"].to_numpy(), np.stack(f["far"].to_numpy()))
            (xv, xi, xf), (qv, qi, qf) = table_of(x), table_of(q)
            rows, _ = best_of_shard(qv, qi, qf, xv, xi, xf, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = vectors.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
