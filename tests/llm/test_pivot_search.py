import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffline.llm import pivot_search as pivots
from staffline.llm.queries import op5_top_k


def brute(rows, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_query_against_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op5_top_k(spark, sf_dir).collect())
    assert got == brute(rows)


def test_odd_vectors_ties_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(pivots, "LEAST_SHARD", 50)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 2)
    rng = random.Random(1)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(6)]) for i in range(400)]
    rows += [(500 + i, [0.5] * 6) for i in range(30)] + [(600, [0.5] * 6)]
    rows += [(700, None), (701, [None] * 6), (702, [float("nan")] * 6), (703, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (800, [0.25, 0.5]), (801, [])]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, shard string, id int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivots.top_k(table, F.col("id") % 100 == 0).collect())
    padded = [(i, v if v is None else v + [0.0] * (6 - len(v))) for i, v in rows]
    assert got == brute(padded)
    assert pivots.top_k(table.limit(0), F.col("id") % 100 == 0).count() == 0
    alone = table.where("vec_id = 100 or vec_id = 7")
    assert [(r.query_id, r.vec_id) for r in pivots.top_k(alone, F.col("id") % 100 == 0).collect()] == [(100, 7)]


@pytest.mark.parametrize("spread", [0.01, 0.2])
def test_bounds_stop_early_and_lose_nothing(spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = np.floor(1024 * (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * spread)).astype(np.int64)
    q = x[:10]
    p = pivots.choose_pivots(x[:500], 32)
    ids = np.arange(4000)
    rows, evaluated = pivots.best_of_shard(q, ids[:10], pivots.distances(q, p), x, ids, pivots.distances(x, p), 10)
    want = []
    for i in range(10):
        s = x @ q[i]
        want += [(i, j, int(s[j])) for j in sorted((j for j in range(4000) if j != i), key=lambda j: (-s[j], j))[:10]]
    assert sorted((int(a), int(b), int(c)) for a, b, c in rows) == sorted(want)
    if spread == 0.01:
        assert evaluated < 0.6 * 10 * 4000
