from datetime import datetime

import pytest
from pyspark.sql import functions as F

from staffline.functions import (
    active_terms,
    clean_text,
    days_between,
    parse_integer,
    parse_number,
    parse_timestamp,
    repair_soft_hyphen,
    round_half_even,
    strip,
    term_flags,
    yes_no,
)
from staffline.functions.text import WHITESPACE
from staffline.operators import columns, decode, stats


def values(spark, function, cells, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("c"))).collect()]


def test_strip_matches_python(spark):
    cells = [f"{w}a{w}b{w}" for w in WHITESPACE] + [WHITESPACE, "", None, "ñandú ", "​x", "Á"]
    assert values(spark, strip, cells) == [c if c is None else c.strip() for c in cells]


def test_clean_text(spark):
    cells = [" a ", "", " nan", "None\t", " ", "nano", None]
    assert values(spark, clean_text, cells) == ["a", None, None, None, None, "nano", None]


def test_timestamps(spark):
    cells = [
        "2010-01-05", "2010-01-05-10.11.12.123456", "bad", "2010-02-30", "9999-12-31",
        "1600-01-01", None, "2010-01-05-10:11:12",
    ]
    assert values(spark, parse_timestamp, cells) == [
        datetime(2010, 1, 5), datetime(2010, 1, 5, 10, 11, 12, 123456), *[None] * 6,
    ]


def test_integers(spark):
    cells = ["7", "7.0", " 7 ", "abc", "1e3", "9007199254740993", "-3.", "1d", None, "99999999999999999999"]
    expected = [7, 7, 7, None, 1000, 9007199254740993, -3, None, None, None]
    assert values(spark, parse_integer, cells) == expected
    assert values(spark, lambda c: parse_integer(c, "null"), ["1.5", "2"]) == [None, 2]
    with pytest.raises(Exception, match="not a whole number: 1.5"):
        values(spark, parse_integer, ["1.5"])
    with pytest.raises(ValueError):
        parse_integer(F.col("c"), "ignore")


def test_numbers(spark):
    assert values(spark, parse_number, ["1.5", " -2e1", "1d", "x", ".5", None]) == [
        1.5, -20.0, None, None, 0.5, None,
    ]


def test_yes_no(spark):
    cells = ["s", " SI ", "1", "n", "No", "0", "x", None]
    assert values(spark, yes_no, cells) == [1, 1, 1, 0, 0, 0, 0, 0]
    assert values(spark, lambda c: yes_no(c, False), cells)[-2:] == [None, None]


def test_rounding_is_half_even(spark):
    import numpy as np

    cells = [0.125, 0.375, 2.675, -0.125, 1.005, 29.4549]
    got = values(spark, lambda c: round_half_even(c, 2), cells, "double")
    assert got == np.round(cells, 2).tolist()


def test_days_round_down(spark):
    noon = datetime(2010, 1, 2, 12)
    cells = [datetime(2010, 1, 3, 11), datetime(2010, 1, 3, 12), datetime(2010, 1, 2), noon]
    got = values(spark, lambda c: days_between(F.lit(noon).cast("timestamp_ntz"), c), cells, "timestamp_ntz")
    assert got == [0, 1, -1, 0]


def test_terms_and_repair(spark):
    df = spark.createDataFrame([("T", None, " x"), (" ", "", None)], "a string, b string, c string")
    flags = term_flags([F.col(c) for c in "abc"])
    assert [r[0] for r in df.select(active_terms(flags)).collect()] == ["1-3", "SIN_TERMINO"]
    assert values(spark, repair_soft_hyphen, ["Garc�­a", "x"]) == ["Garcia", "x"]


def test_column_survival(spark):
    rows = [(i, "k", "x" if i < 2 else None, None, "a" if i else None) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, same string, `few.1` string, none string, one string")
    assert columns.drop_sparse(df, 0.8).columns == ["id", "same", "one"]
    assert columns.drop_sparse(df, 0.81).columns == ["id", "same", "few.1", "one"]
    assert columns.drop_constant(df, ["same"]).columns == ["id", "same"]
    assert columns.drop_uninformative(df, 0.8, ["same"]).columns == ["id", "same"]
    empty = df.limit(0)
    assert columns.drop_sparse(empty).columns == df.columns
    assert columns.drop_constant(empty).columns == []


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    found = columns.profile(df)["x"]
    assert round(found.null_ratio, 3) == 0.667 and found.constant


def test_flags_are_found(spark):
    df = spark.createDataFrame([("S", "S", None), ("n ", "q", None)], "a string, b string, c string")
    assert columns.flag_columns(df) == ["a"]
    assert [tuple(r) for r in columns.cast_flags(df).collect()] == [(1, "S", None), (0, "q", None)]


def test_decoding(spark):
    df = spark.createDataFrame(
        [("PC", "PR"), ("ZZ", None)], "CATEXPERIENCIA string, ROLACADEMICO string"
    )
    assert [tuple(r)[2:] for r in decode.describe_experience(df).collect()] == [
        ("POR CLASIFICAR", "PROFESOR"), (None, None),
    ]
    df = spark.createDataFrame(
        [("AA", "7.0"), ("DD", "3"), (None, None)], "TIPOEMPLEADO string, IDREGIMENLABORAL string"
    )
    assert [tuple(r)[2:] for r in decode.describe_contracts(df).collect()] == [
        ("ADMINISTRATIVO", "LOSEP - LEY ORGANICA DE SERVICIO PUBLICO"),
        ("DOCENTE", None), (None, None),
    ]
    with pytest.raises(AssertionError, match="ZZ"):
        codes = spark.createDataFrame([("ZZ",), ("DI",), (None,)], "area string")
        decode.require_mapped(codes, "area", decode.TRAINING_AREA)


def test_no_corrections_change_nothing(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, x double")
    assert df.select(decode.override(F.col("id"), {}, F.col("x"))).first()[0] == 2.0


@pytest.mark.parametrize("task_rows", [10**6, 3])
def test_quantiles_interpolate(spark, task_rows):
    import numpy as np

    data = [5.0] * 40 + [float(i * i % 97) for i in range(101)] + [-3.5]
    df = spark.createDataFrame([(x,) for x in data] + [(None,), (float("nan"),)], "x double")
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = stats.quantiles(df, F.col("x"), at, task_rows)
    assert got == pytest.approx(np.quantile(data, at).tolist())
    assert stats.quantiles(df.limit(0), F.col("x"), [0.5], task_rows) == [None]


@pytest.mark.parametrize("clip", [None, 0.9])
def test_histogram_matches_numpy(spark, clip):
    import numpy as np

    data = [i * 0.1 for i in range(300)] + [500.0]
    df = spark.createDataFrame([(str(x),) for x in data] + [("bad",), (None,)], "x string")
    kept = [x for x in data if clip is None or x <= np.quantile(data, clip)]
    counts, edges = np.histogram(kept, 30)
    got = stats.histogram(df, F.col("x"), 30, clip, task_rows=20).collect()
    assert [r.n for r in got] == counts.tolist()
    assert [r.lower for r in got] == pytest.approx(edges[:-1].tolist())
    assert got[-1].upper == edges[-1]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(4.0,)] * 3, "x double")
    got = stats.histogram(df, F.col("x"), 2, None).collect()
    assert [(r.lower, r.upper, r.n) for r in got] == [(3.5, 4.0, 0), (4.0, 4.5, 3)]
    assert [r.n for r in stats.histogram(df.limit(0), F.col("x"), 2).collect()] == [0, 0]


def test_outlier_mask_is_never_null(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(999.0,), (None,)], "x double")
    mask, low, high = stats.iqr_outliers(df, "x")
    assert [r.x for r in df.where(mask).collect()] == [999.0]
    assert df.where(~mask).count() == 21 and low < 0 < high


def test_shape_and_top(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (" b", None), ("", 2)], "t string, n int")
    assert tuple(stats.table_shape(df).first()) == (4, 2, 1)
    assert tuple(stats.table_shape(df, duplicates=False).first()) == (4, 2)
    assert tuple(stats.table_shape(df.limit(0)).first()) == (0, 2, 0)
    assert [tuple(r) for r in stats.top_values(df, "t").collect()] == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in stats.null_percentages(df).collect()] == [("n", 25.0)]


def test_quantiles_over_the_sketch(spark):
    """More rows than one bracket of the sketch resolves, half of them one value."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, 500.0).otherwise((F.col("id") * 7919 % 100_003) / 100).alias("x")
    )
    at = [0.01, 0.25, 0.4999, 0.75, 0.999]
    expected = df.agg(F.percentile("x", at)).first()[0]
    assert stats.quantiles(df, F.col("x"), at, task_rows=20) == pytest.approx(expected, abs=1e-9)


def test_quantiles_keep_infinities(spark):
    rows = [(1.0,), (2.0,), (3.0,), (4.0,), (float("inf"),)]
    df = spark.createDataFrame(rows, "x double")
    for task_rows in (100, 2):
        assert stats.quantiles(df, F.col("x"), [0.75, 1.0], task_rows) == [4.0, float("inf")]


def test_repeated_keys_of_a_catalogue_raise(spark):
    codes = spark.createDataFrame([(1,), (2,)], "code int")
    catalogue = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "code int, name string")
    with pytest.raises(ValueError, match="not unique"):
        decode.decode_from(codes, catalogue, "code")
    kept = decode.decode_from(codes, catalogue.where("name <> 'b'"), "code")
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a"), (2, None)]


def test_duplicates_removed_in_one_scan(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    found = stats.duplicates_removed(df)
    assert tuple(found.first()) == (3, 2, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from staffline.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_states_of_files_add_up_to_the_profile(spark):
    rng = __import__("random").Random(3)
    rows = [
        (f"f{i % 4}", rng.choice([None, 9.0, 10.0, float("nan")]), rng.choice([None, "si", "NO"]), "x", 10 if i % 4 else 9, None)
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "f string, a double, b string, c string, d int, e string")
    data = df.drop("f")
    states = columns.profile_states(df.select("f", *data.columns), F.col("f")).where("column != 'f'")
    parts = [states.where(F.col("file").isin(*own)) for own in (["f0", "f2"], ["f1", "f3"])]
    merged = columns.merged_profiles(parts[0].unionByName(parts[1]), data.columns)
    assert merged == columns.profile(data, flags=True)
    nothing = columns.merged_profiles(states.limit(0), ["a"])
    assert nothing == columns.profile(data.limit(0).select("a"), flags=True)


def test_frequent_texts_are_proven_or_counted(spark):
    from staffline.operators import stats

    heavy = [("t%02d" % i, 200 - 7 * (i // 2)) for i in range(12)]  # ties in pairs
    rows = [(w,) for w, n in heavy for _ in range(n)] + [(f" u{i} ",) for i in range(4000)] + [("",), (None,), ("  ",)] * 50
    df = spark.createDataFrame(rows, "w string").repartition(6)
    expected = [tuple(r) for r in stats.top_values(df, "w", 7).collect()]
    assert expected == heavy[:7]
    trimmed = df.select(F.trim("w").alias("w")).where("w != ''")
    assert stats.proven_top(trimmed, "w", 7, items=1024) == expected
    assert [tuple(r) for r in stats.top_values(df, "w", 7, small_bytes=0).collect()] == expected
    # Too few counters, or an answer that hangs on values that occur once, prove nothing.
    assert stats.proven_top(trimmed, "w", 7, items=32) is None
    assert stats.proven_top(trimmed, "w", 20, items=1024) is None
    assert [tuple(r) for r in stats.top_values(df, "w", 20, small_bytes=0).collect()] == [
        tuple(r) for r in stats.top_values(df, "w", 20).collect()]
    # Fewer values than candidates: the sketch is exact.
    few = spark.createDataFrame([("a",), ("b",), ("a",)], "w string")
    assert stats.proven_top(few, "w", 5, items=1024) == [("a", 2), ("b", 1)]
    assert stats.proven_top(few.limit(0), "w", 5, items=1024) == []


def test_proven_texts_are_not_shuffled(spark):
    from staffline.operators import stats

    rows = spark.range(200_000).selectExpr("if(id % 3 = 0, concat('h', id % 5), concat('u', id)) AS w")
    group = "proven-top"
    spark.sparkContext.setJobGroup(group, group)
    best = stats.proven_top(rows, "w", 5)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [n for _, n in best] == sorted((n for _, n in best), reverse=True) and {w[0] for w, _ in best} == {"h"}
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    assert 0 < len(jobs) <= 4


def wide_rows(spark):
    nan, rng = float("nan"), __import__("random").Random(5)
    kinds = [(None, "a"), ("a", None), (None, None), ("a", "a")]
    rows = [(i, *rng.choice(kinds), rng.choice([0.0, -0.0, nan, None, 1.5]), *["x" * 50] * 6) for i in range(400)]
    rows += [rows[i] for i in (3, 3, 5, 300)] + [(7000, None, "a", 0.0, *["y"] * 6), (7000, None, "a", -0.0, *["y"] * 6)]
    rows += [(7001, "a", None, nan, *["y"] * 6), (7001, "a", None, nan, *["y"] * 6), (7001, None, "a", nan, *["y"] * 6)]
    return spark.createDataFrame(rows, "k int, a string, b string, d double, " + ", ".join(f"t{i} string" for i in range(6))).repartition(5)


def test_duplicates_by_digest_are_those_of_whole_rows(spark, monkeypatch):
    from staffline.operators import duplicates

    df = wide_rows(spark)
    plain = df.dropDuplicates()
    assert df.count() - plain.count() == 6
    show = lambda t: sorted(str(tuple(abs(v) if isinstance(v, float) else v for v in r)) for r in t.collect())
    assert show(duplicates.without_duplicates(df)) == show(plain)
    one, other = (stats.table_shape(df, small_bytes=b).collect() for b in (0, 1 << 40))
    assert one == other and one[0].duplicate_rows == 6
    for empty in (df.limit(0), df.where("k < 100").dropDuplicates(["k"])):
        assert stats.table_shape(empty, small_bytes=0).collect() == stats.table_shape(empty, small_bytes=1 << 40).collect()
    # Digests that collide change nothing, nor do tables of nothing but copies.
    same = F.struct(F.lit(1).alias("d1"), F.lit(2).alias("d2"))
    monkeypatch.setattr(duplicates, "MOST_REPEATED", 1.0)
    monkeypatch.setattr(duplicates, "row_digest", lambda df: same)
    assert show(duplicates.without_duplicates(df)) == show(plain)
    monkeypatch.undo()
    copies = df.unionByName(df)
    assert show(duplicates.without_duplicates(copies)) == show(plain)


def test_digests_move_and_rows_do_not(spark):
    from staffline.operators import duplicates

    df = wide_rows(spark)
    plan = duplicates.repeated_digests(df, duplicates.row_digest(df))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("_digest" in line and "t0" not in line for line in moved)
    assert duplicates.row_digest(spark.createDataFrame([({"a": 1},)], "m map<string,int>")) is None
