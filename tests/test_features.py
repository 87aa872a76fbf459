import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from staffline.operators.features import contract_features, person_features
from staffline.operators.periods import continuous_periods

SCHEMA = (
    "IDPERSONA bigint, IDCONTRATOLABORAL bigint, FECHAINICIOCONTRATO timestamp_ntz, "
    "FECHAFINCONTRATO timestamp_ntz, CARGO string, RMU double, IDESTRUCTURAORGANICA bigint, "
    "NOMBRE_UNIDAD string, IDREGIMENLABORAL_DESC string, TIPOEMPLEADO_DESC string, "
    "TIPODEDICACION string, ESTADOCONTRATO string, TIPO string"
)
AS_OF = datetime(2013, 1, 1)


@pytest.mark.parametrize(
    "rows, observed, documented",
    [
        ([("A", 1.0), ("A", 1.0), ("B", 1.0), ("B", 2.0)], 3, 3),
        ([("A", 1.0), (None, 1.0), ("A", 1.0)], 1, 3),
        ([("A", None), ("A", None)], 0, 1),
    ],
)
def test_change_counting(spark, rows, observed, documented):
    start = datetime(2010, 1, 1)
    data = [(1, i, start + timedelta(days=i), c, r) for i, (c, r) in enumerate(rows)]
    df = spark.createDataFrame(
        data,
        "IDPERSONA int, IDCONTRATOLABORAL int, FECHAINICIOCONTRATO timestamp_ntz, "
        "CARGO string, RMU double",
    )
    for null_safe, expected in ((False, observed), (True, documented)):
        got = contract_features(df, "2013-01-01", null_safe_changes=null_safe).first()
        assert got.N_CONTRATOS_TOTAL == expected
    posts = contract_features(df.drop("RMU"), "2013-01-01").first().N_CONTRATOS_TOTAL
    known = [c for c, _ in rows]
    assert posts == sum(
        a is not None and b is not None and a != b for a, b in zip(known, known[1:])
    )
    bare = contract_features(df.drop("RMU", "CARGO"), "2013-01-01").first()
    assert bare.N_CONTRATOS_TOTAL == len(rows)


def random_rows(persons, seed):
    rnd = random.Random(seed)

    def pick(*values):
        return rnd.choice(values)

    rows = []
    for person in range(persons):
        for _ in range(rnd.randint(1, 15)):
            start = datetime(2005, 1, 1) + timedelta(days=rnd.randint(0, 1500))
            end = pick(None, start + timedelta(days=rnd.randint(0, 300)))
            rows.append((
                person, len(rows), start, end,
                pick("JEFE", "ANALISTA", "PROFESOR", None),
                pick(800.0, 950.5, 1200.25, 0.0, None),
                pick(1, 2, 3, None),
                pick("Facultad A", "FACULTAD B", "Vicerrectorado X", "Centro", None),
                pick("LOES", "LOSEP", None),
                pick("DOCENTE", "ADMINISTRATIVO", None),
                pick("TC", "MT", "TP", None),
                pick("FF", "VI", None),
                pick("V", "M", None),
            ))
    return rows


def known(values):
    return [v for v in values if v is not None]


def most_frequent(values):
    counts = Counter(values)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def expected_features(own):
    own = sorted(own, key=lambda r: (r[2], r[1]))
    posts, pays = [r[4] for r in own], [r[5] for r in own]
    changes = 0
    for i in range(len(own)):
        p, q = posts[i], posts[i - 1] if i else None
        if p is None and q is None:
            by_post = False
        elif p is None or q is None:
            by_post = None
        else:
            by_post = p != q
        by_pay = pays[i] != (pays[i - 1] if i else None)
        changes += bool(by_post) or by_pay
    by_year = {}
    for r in own:
        by_year.setdefault(r[2].year, set()).update(known([r[4]]))
    units = known(r[7] for r in own)
    roles = known(r[9] for r in own)
    days = {"DOCENTE": 0, "ADMINISTRATIVO": 0}
    for r in own:
        if r[9]:
            days[r[9]] += ((r[3] or AS_OF) - r[2]).days + 1
    dedications = known(r[10] for r in own if r[9] == "DOCENTE")
    paid = known(pays)
    growth = paid[-1] - paid[0] if paid else None
    finished = [r[11] == "FF" for r in own if r[12] == "V" and r[11] is not None]
    return {
        "N_REGISTROS_HISTORIAL": len(own),
        "N_CONTRATOS_TOTAL": changes,
        "N_CARGOS_DISTINTOS": len(set(known(posts))),
        "CARGO_ACTUAL": posts[-1],
        "CARGO_MAS_FRECUENTE": most_frequent(known(posts)),
        "MULTIPLES_CARGOS_MISMO_ANIO": any(len(v) > 1 for v in by_year.values()),
        "N_UNIDADES_DISTINTAS": len(set(known(r[6] for r in own))),
        "UNIDAD_ACTUAL_NOMBRE": own[-1][7],
        "N_FACULTADES_DISTINTAS": len({u for u in units if "FACULTAD" in u.upper()}),
        "PASO_POR_RECTORADO": any("RECTORADO" in u.upper() for u in units),
        "N_REGIMENES_DISTINTOS": len(set(known(r[8] for r in own))),
        "REGIMEN_INICIAL_DESC": own[0][8],
        "REGIMEN_ACTUAL_DESC": own[-1][8],
        "TIPOEMPLEADO_ACTUAL_DESC": own[-1][9],
        "ES_DOCENTE_ADMIN_MIXTO": len(set(roles)) > 1,
        "ANIOS_EXPERIENCIA_DOCENTE": round(days["DOCENTE"] / 365.25, 2),
        "ANIOS_EXPERIENCIA_ADMINISTRATIVO": round(days["ADMINISTRATIVO"] / 365.25, 2),
        "DEDICACION_DOCENTE_ACTUAL": dedications[-1] if dedications else None,
        "DEDICACION_DOCENTE_MAS_FRECUENTE": most_frequent(dedications),
        "N_DEDICACIONES_DOCENTE_DISTINTAS": len(set(dedications)),
        "RMU_INICIAL": paid[0] if paid else None,
        "RMU_ACTUAL": paid[-1] if paid else None,
        "RMU_MIN": min(paid, default=None),
        "RMU_MAX": max(paid, default=None),
        "RMU_PROMEDIO": round(sum(paid) / len(paid), 2) if paid else None,
        "RMU_CRECIMIENTO_ABS": growth,
        "RMU_CRECIMIENTO_PCT": round(growth / paid[0] * 100, 2) if paid and paid[0] else None,
        "N_CAMBIOS_RMU": sum(a != b for a, b in zip(paid, paid[1:])) if paid else None,
        "PROPORCION_CONTRATOS_FINALIZADOS": (
            round(sum(finished) / len(finished), 2) if finished else None
        ),
    }


@pytest.fixture(scope="module")
def staff(spark):
    rows = random_rows(120, seed=7)
    by_person = {}
    for r in rows:
        by_person.setdefault(r[0], []).append(r)
    return (
        spark.createDataFrame(rows, SCHEMA).cache(),
        {p: expected_features(own) for p, own in by_person.items()},
    )


@pytest.mark.parametrize("hot_rows", [None, 8])
def test_contract_features_match_plain_python(staff, hot_rows):
    df, expected = staff
    got = contract_features(df, "2013-01-01", with_pay=True, hot_rows=hot_rows).collect()
    assert len(got) == len(expected)
    for row in got:
        values = row.asDict()
        want = expected[values.pop("IDPERSONA")]
        assert list(values) == list(want)
        for name, value in want.items():
            if isinstance(value, float):
                assert values[name] == pytest.approx(value, abs=0.0101), name
            else:
                assert values[name] == value, name


def test_pay_stays_out_by_default(staff):
    df, _ = staff
    names = contract_features(df, "2013-01-01").columns
    assert not [n for n in names if n.startswith("RMU")]
    assert "N_CONTRATOS_TOTAL" in names


def test_tenure_is_joined(staff):
    df, expected = staff
    periods = continuous_periods(df, "2013-01-01")
    rows = person_features(df, periods, "2013-01-01").collect()
    assert len(rows) == len(expected)
    spans = {}
    for p in periods.collect():
        spans.setdefault(p.IDPERSONA, []).append(p)
    for r in rows:
        own = spans[r.IDPERSONA]
        first = min(p.PERIODO_INICIO for p in own)
        last = max(p.PERIODO_FIN or AS_OF for p in own)
        assert r.FECHA_PRIMER_INGRESO == first
        assert r.FECHA_ULTIMO_PERIODO_FIN == last
        assert r.N_REINGRESOS == len(own) - 1
        assert r.VIGENTE_ACTUALMENTE == any(p.PERIODO_VIGENTE for p in own)
        assert r.ANTIGUEDAD_EFECTIVA_DIAS == sum(p.PERIODO_DURACION_DIAS for p in own)
        assert r.ANTIGUEDAD_CALENDARIO_DIAS == (last - first).days + 1
        assert r.ANTIGUEDAD_CALENDARIO_ANIOS == round((last - first).days / 365.25 + 1 / 365.25, 2)


def test_persons_without_any_value_count_nothing_on_either_path(spark):
    rows = [(1, i, datetime(2010, 1, 1 + i), None, None) for i in range(12)]
    schema = "IDPERSONA long, IDCONTRATOLABORAL long, FECHAINICIOCONTRATO timestamp, IDESTRUCTURAORGANICA long, CARGO string"
    df = spark.createDataFrame(rows, schema)
    for columns in (df.columns, df.columns[:-1]):
        plain, hot = (
            contract_features(df.select(columns), "2013-01-01", hot_rows=n).collect() for n in (None, 5)
        )
        assert plain == hot and plain[0].N_UNIDADES_DISTINTAS == 0
