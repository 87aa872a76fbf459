"""Steps that keep large tables cheap: what they leave out or send must not change results."""

import pytest
from pyspark.sql import functions as F

from staffline.functions import elapsed_years
from staffline.operators import duplicates, stats
from staffline.operators.stats import table_shape
from staffline.plans import charts, process
from staffline.plans.process import clean_source
from staffline.plans.sources import Chart, Source


def test_rows_that_have_no_like_stay_where_they_are(spark, monkeypatch):
    """Repeated digests go to the tasks, not wide rows to them, whatever Spark's own threshold; a
    table that carries its digests has the shape of one that does not."""
    df = spark.range(300).selectExpr("id % 290 k", *(f"concat('v', id % 290 + {i}) t{i}" for i in range(9))).repartition(4)
    keyed = duplicates.with_digest(df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in (df, keyed):
            doubtful, single = duplicates._with_like(table)
            for part in (doubtful, single):
                plan = part._jdf.queryExecution().executedPlan().toString()
                assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert (doubtful.count(), single.count()) == (20, 280) and single.columns == df.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for sent in (0, duplicates.SENT_DIGESTS):
        monkeypatch.setattr(duplicates, "SENT_DIGESTS", sent)
        for table in (df, keyed, keyed.unionByName(keyed), keyed.where("k > 100")):
            shown = duplicates.without_digest(table)
            expected = shown.count(), len(df.columns), shown.count() - shown.distinct().count()
            assert {tuple(table_shape(table, small_bytes=b).first()) for b in (0, 1 << 40)} == {expected}
            assert duplicates.without_duplicates(table).count() == shown.distinct().count()


@pytest.mark.parametrize("dedupe", [False, True])
def test_columns_that_go_anyway_are_not_staged(spark, monkeypatch, dedupe):
    """Unless repeated rows are told by them: these differ in nothing else."""
    seen = []
    staged_as_before = process.staged_with_profile
    monkeypatch.setattr(process, "staged_with_profile", lambda df: seen.append(df.columns) or staged_as_before(df))
    raw = spark.createDataFrame([("1", " a", "x"), ("1", "a", "y"), ("1", "a ", "y"), ("2", "b", "x")], "ID string, T string, GONE string")
    source = Source("f", "o", dedupe=dedupe, drop=("GONE", "MISSING"), integers=("ID",))
    rows = [tuple(r) for r in clean_source(raw, source, stage=True).collect()]
    assert sorted(rows) == [(1, "a")] * (2 if dedupe else 3) + [(2, "b")]
    assert seen == [["ID", "T", "GONE"] if dedupe else ["ID", "T"]]


def test_a_histogram_works_its_numbers_out_once(spark):
    """Its bins refer to a number often; what it is made of is only seen by the two checks, that it
    is a number and within the clip limit."""
    rows = spark.range(400).selectExpr(
        "timestamp_ntz '2001-01-01' a", "timestamp_ntz '2001-01-01' + make_dt_interval(cast(id as int)) b",
        "CASE id % 4 WHEN 0 THEN ' ' WHEN 1 THEN '' WHEN 2 THEN ' x ' END t",
    )
    value = lambda: elapsed_years(F.col("a"), F.col("b"))
    source = Source("f", "o", charts=(Chart("histogram", "YEARS", bins=7, clip=0.9, value=value), Chart("top", "t")))
    found = charts.chart_rows(rows, source)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.lower().count("datediff") + plan.lower().count("date_diff") <= 4
    got = {(r.chart, r.key): r.n for r in found.collect()}
    plain = {("histogram:YEARS", str(r.bin)): r.n for r in stats.histogram(rows, value(), 7, 0.9).collect()}
    assert got == plain | {("top:t", "x"): 100}
