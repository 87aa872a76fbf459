import calendar
import random
from datetime import datetime, timedelta

import pytest

from staffline.operators.history import CHUNK_ROWS, chunk_count, ordered_histories
from staffline.operators.periods import continuous_periods, contract_periods

SCHEMA = (
    "IDPERSONA bigint, IDCONTRATOLABORAL bigint, FECHAINICIOCONTRATO timestamp_ntz, "
    "FECHAFINCONTRATO timestamp_ntz, FECHADESVINCULACION timestamp_ntz"
)
AS_OF = datetime(2013, 1, 1)
FAR = datetime(9999, 1, 1)


def day(text, year=2010):
    if text is None:
        return None
    return datetime.fromisoformat(text if len(text) == 10 else f"{year}-{text}")


# name -> (contracts as start, end[, dismissal]; expected periods as start, end, n)
CASES = {
    "overlap": ([("01-01", "03-31"), ("02-01", "06-30")], [("01-01", "06-30", 2)]),
    "contained": ([("01-01", "12-31"), ("03-01", "04-30")], [("01-01", "12-31", 2)]),
    "same day": ([("01-01", "01-31"), ("01-31", "02-28")], [("01-01", "02-28", 2)]),
    "next day": ([("01-01", "04-15"), ("04-16", "05-31")], [("01-01", "05-31", 2)]),
    "two day gap": (
        [("04-01", "04-15"), ("04-18", "05-31")],
        [("04-01", "04-15", 1), ("04-18", "05-31", 1)],
    ),
    "month cut": ([("01-01", "01-29"), ("02-01", "03-31")], [("01-01", "03-31", 2)]),
    "month cut too early": (
        [("01-01", "01-28"), ("02-01", "03-31")],
        [("01-01", "01-28", 1), ("02-01", "03-31", 1)],
    ),
    "february": ([("01-01", "02-26"), ("03-01", "03-31")], [("01-01", "03-31", 2)]),
    "leap february": (
        [("2012-01-01", "2012-02-26"), ("2012-03-01", "2012-03-31")],
        [("2012-01-01", "2012-02-26", 1), ("2012-03-01", "2012-03-31", 1)],
    ),
    "year change": (
        [("2009-11-01", "2009-12-30"), ("01-01", "02-28")],
        [("2009-11-01", "02-28", 2)],
    ),
    "open then later": ([("01-01", None), ("06-01", "06-30")], [("01-01", None, 2)]),
    "later open": ([("01-01", "06-30"), ("03-01", None)], [("01-01", None, 2)]),
    "dismissal wins": (
        [("01-01", "12-31", "03-31"), ("06-01", "06-30")],
        [("01-01", "03-31", 1), ("06-01", "06-30", 1)],
    ),
    "null start": ([(None, "03-31"), ("05-01", "05-31")], [("05-01", "05-31", 1)]),
    "inverted month cut": (
        [("01-01", "01-31"), ("02-01", "01-15")],
        [("01-01", "01-15", 2)],
    ),
}


def test_case_table(spark):
    rows, expected = [], set()
    for person, (contracts, periods) in enumerate(CASES.values()):
        for contract, c in enumerate(contracts):
            start, end, dismissed = (*c, None)[:3]
            rows.append((person, contract, day(start), day(end), day(dismissed)))
        expected |= {(person, day(s), day(e), e is None, n) for s, e, n in periods}
    df = spark.createDataFrame(rows, SCHEMA)
    got = continuous_periods(df, "2013-01-01").select(
        "IDPERSONA", "PERIODO_INICIO", "PERIODO_FIN", "PERIODO_VIGENTE", "N_CONTRATOS"
    )
    assert {tuple(r) for r in got.collect()} == expected


def random_contracts(persons, seed):
    rnd = random.Random(seed)
    rows = []
    for person in range(persons):
        timed = rnd.random() < 0.3
        for _ in range(rnd.randint(1, 14)):
            start = datetime(2010, 1, 1) + timedelta(
                days=rnd.randint(0, 150), hours=rnd.choice([0, 0, 10]) if timed else 0
            )
            end = start + timedelta(
                days=rnd.randint(-25, 40), hours=rnd.choice([0, 5]) if timed else 0
            )
            rows.append((person, len(rows), start, None if rnd.random() < 0.05 else end, None))
    return rows


def fold(contracts):
    """One contract at a time, straight from the written rules."""
    periods = []
    for _, contract, start, end, _ in sorted(contracts, key=lambda r: (r[2], r[1])):
        end = end or FAR
        if periods:
            current = periods[-1]
            reached = current[1]
            last = calendar.monthrange(reached.year, reached.month)[1]
            month = (reached.year + reached.month // 12, reached.month % 12 + 1)
            cut = (
                reached.day >= last - 2
                and start.day == 1
                and (start.year, start.month) == month
            )
            if reached >= start or cut or reached + timedelta(days=1) == start:
                current[1] = max(reached, end) if reached >= start else end
                current[2].append(contract)
                continue
        periods.append([start, end, [contract]])
    return {
        (
            start,
            None if end == FAR else end,
            end == FAR,
            ((AS_OF if end == FAR else end) - start).days + 1,
            len(ids),
            ",".join(map(str, ids)),
        )
        for start, end, ids in periods
    }


@pytest.fixture(scope="module")
def histories(spark):
    rows = random_contracts(300, seed=11)
    by_person = {}
    for r in rows:
        by_person.setdefault(r[0], []).append(r)
    expected = {(p, *x) for p, own in by_person.items() for x in fold(own)}
    assert any(r[3] and r[3] < r[2] for r in rows)
    return spark.createDataFrame(rows, SCHEMA).cache(), expected


@pytest.mark.parametrize("hot_rows", [None, 9])
def test_random_histories_match_the_fold(histories, hot_rows):
    df, expected = histories
    got = continuous_periods(df, "2013-01-01", hot_rows=hot_rows)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected)
    assert set(rows) == expected


def test_one_person_spread_over_many_chunks(spark):
    """A third of all rows belong to one person, who must not sit in one task."""
    rows = random_contracts(60, seed=3)
    base = datetime(2000, 1, 1)
    rnd = random.Random(4)
    for i in range(220):
        start = base + timedelta(days=rnd.randint(0, 900))
        rows.append((-1, 10_000 + i, start, start + timedelta(days=rnd.randint(-9, 6)), None))
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {(-1, *x) for x in fold([r for r in rows if r[0] == -1])}
    got = continuous_periods(df, "2013-01-01", hot_rows=40).where("IDPERSONA = -1")
    assert {tuple(r) for r in got.collect()} == expected


def test_long_lists_are_whole_on_the_hot_path(spark):
    rows = [(1, i, datetime(2010, 1, 1), datetime(2010, 2, 1), None) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    period = continuous_periods(df, "2013-01-01", hot_rows=10).collect()
    ids = ",".join(map(str, range(30)))
    assert [(r.N_CONTRATOS, r.IDCONTRATOLABORAL) for r in period] == [(30, ids)]
    listed = contract_periods(df, hot_rows=10).collect()
    assert sorted((r.PERIODO, r.IDCONTRATOLABORAL) for r in listed) == [
        (1, i) for i in range(30)
    ]


def test_empty_input_keeps_the_schema(spark):
    got = continuous_periods(spark.createDataFrame([], SCHEMA), "2013-01-01")
    assert got.columns == [
        "IDPERSONA", "PERIODO_INICIO", "PERIODO_FIN", "PERIODO_VIGENTE",
        "PERIODO_DURACION_DIAS", "N_CONTRATOS", "IDCONTRATOLABORAL",
    ]
    assert got.count() == 0


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "IDPERSONA bigint")
    with pytest.raises(KeyError, match="FECHAINICIOCONTRATO"):
        continuous_periods(df, "2013-01-01")


def test_ordinary_histories_need_one_exchange(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_custkey IDPERSONA", "o_orderkey IDCONTRATOLABORAL",
        "o_orderdate FECHAINICIOCONTRATO", "o_orderdate FECHAFINCONTRATO",
    )
    plan = continuous_periods(df, "2013-01-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


@pytest.mark.parametrize("hot_total", [100, 900_000, 9_000_000, 54_000_000])
def test_low_hot_rows_make_no_more_chunks_than_tasks_need(hot_total):
    """Every person is hot here; the chunks still hold as many rows as a task can take."""
    chunks = chunk_count(hot_total, hot_rows=8, tasks=48)
    assert chunks <= max(48, hot_total // CHUNK_ROWS + 1)
    assert chunks == 13 if hot_total == 100 else hot_total / chunks <= CHUNK_ROWS


def test_hot_persons_share_chunks(spark, histories):
    df, _ = histories
    (hot,) = [p for p in ordered_histories(df, "IDPERSONA", ["FECHAINICIOCONTRATO", "IDCONTRATOLABORAL"], 1) if p.chunk]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 1 < hot.rows.select(hot.chunk).distinct().count() <= tasks
