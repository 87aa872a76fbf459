import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffline.operators import sketches, stats

ASKED = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(9)
    odd = [float("inf"), float("-inf"), float("nan"), None]
    rows = [(i % 5, rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1), *odd] if i % 40 == 0 else [rng.gauss(0, 1), 7.0])) for i in range(30_000)]
    df = spark.createDataFrame(rows, "part int, x double").withColumn("t", F.col("x").cast("string")).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def states(spark, numbers, tmp_path_factory):
    """Stored part by part, as runs would add them."""
    path = str(tmp_path_factory.mktemp("sketches") / "store")
    for own in ([0, 1], [2], [3, 4]):
        part = numbers.where(F.col("part").isin(own))
        sketches.sketch_states(part, ["x", "t"], F.col("part")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def jobs_of(spark, action):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_states_add_up(spark, numbers, states):
    assert states.count() == 10
    for name in ("x", "t"):  # text that spells no number is left out
        real = stats._numbers(numbers, F.col(name)).count()
        assert sketches.sketch_count(spark, sketches.merged_sketch(states, name)) == real
    assert sketches.sketch_count(spark, sketches.merged_sketch(states, "other")) == 0


def test_ranks_of_approximate_quantiles(spark, numbers, states):
    values = np.sort([r.x for r in numbers.where("x is not null and not isnan(x)").select("x").collect()])
    got = sketches.approximate_quantiles(spark, sketches.merged_sketch(states, "x"), ASKED)
    for p, value in zip(ASKED, got):
        low, high = (np.searchsorted(values, value, side) / len(values) for side in ("left", "right"))
        assert low - 2 * sketches.RANK_ERROR <= p <= high + 2 * sketches.RANK_ERROR
    assert sketches.approximate_quantiles(spark, None, ASKED) == [None] * len(ASKED)


def test_exact_quantiles_take_fewer_scans_with_a_sketch(spark, numbers, states):
    for value in ("x", "t"):
        sketch = sketches.merged_sketch(states, value)
        plain, without = jobs_of(spark, lambda: stats.quantiles(numbers, F.col(value), ASKED, task_rows=2000))
        seeded, with_it = jobs_of(spark, lambda: stats.quantiles(numbers, F.col(value), ASKED, task_rows=2000, sketch=sketch))
        assert seeded == plain
        # Two jobs of the seeded one read the sketch, no data.
        assert with_it - 3 < without
        assert plain == stats.quantiles(numbers, F.col(value), ASKED)


def test_a_sketch_of_other_data_changes_nothing(spark, numbers, states):
    plain = stats.quantiles(numbers, F.col("x"), ASKED, task_rows=2000)
    other = numbers.where("part < 3").select("part", (F.col("x") * 3 + 50).alias("x"))
    fewer = sketches.merged_sketch(sketches.sketch_states(other, ["x"], F.lit("all")), "x")
    moved = sketches.merged_sketch(sketches.sketch_states(numbers.select((F.col("x") + 50).alias("x")), ["x"], F.lit("all")), "x")
    for sketch in (fewer, moved):
        assert stats.quantiles(numbers, F.col("x"), ASKED, task_rows=2000, sketch=sketch) == plain


def test_whiskers_from_the_sketch_alone(spark, numbers, states):
    sketch = sketches.merged_sketch(states, "x")
    exact = stats.iqr_bounds(numbers, "x")
    near = stats.iqr_bounds(numbers, "x", sketch=sketch, approximate=True)
    assert near == pytest.approx(exact, abs=0.3)
    assert stats.iqr_bounds(numbers, "x", sketch=sketch, task_rows=2000) == exact
    empty = sketches.merged_sketch(sketches.sketch_states(numbers.limit(0), ["x"], F.lit("all")), "x")
    assert stats.iqr_bounds(numbers.limit(0), "x", sketch=empty, approximate=True) == (None, None)
