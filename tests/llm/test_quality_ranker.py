import zlib

import numpy as np
import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from staffline.llm import quality_ranker as q
from staffline.llm.queries import in_fold, op1_quality


def area_under_curve(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = good.sum()
    return (rank[good == 1].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = op1_quality(spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert area_under_curve(both.score.to_numpy(), both.quality.to_numpy()) > 0.9
    assert (both.predicted == both.quality).mean() > 0.9


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(in_fold(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (q.train(docs, x, "quality", ~in_fold(5, 0)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_preferences_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    good = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=2000) * 0.1 > 0.8).astype(int)
    ranker = q.fit(x, good)
    assert ranker.weights[0] > 0 > ranker.weights[1]
    assert ((ranker.scores(x) >= q.CUT) == good).mean() > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 1), (6, 0), (None, 1), (5, None), (99, 0)]])
def test_odd_cases(spark, labels):
    docs = odd_documents(spark)
    ranker = q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "quality", F.lit(True))
    got = q.scored(docs, ranker).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (3, 4, 5)}
    assert len(blank) == 1
    assert q.scored(no_documents(spark), ranker).count() == 0
