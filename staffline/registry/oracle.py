"""The SQL counterparts, for DuckDB, written against the same tables."""

from __future__ import annotations

from staffline.plans.sources import (
    FEATURES_OUTPUT,
    HISTORY_OUTPUT,
    PERIODS_OUTPUT,
)
from staffline.registry.standins import (
    CELLS,
    HISTORY_FILLED_SQL,
    HISTORY_SQL,
    RAW,
    Cell,
    raw_sql,
)

# Spelled out here too, so that a slip in the library's lists shows.
NULL_TOKENS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BLANK_AFTER_TRIM = ("", "nan", "None")
DEDUPED = ("heteroevaluacion_disponible", "proyecto_grado")

FAR = "TIMESTAMP '9999-12-31'"
AS_OF = "TIMESTAMP '2002-01-01'"

# Unicode white space as a character class; chr() keeps the odd ones out of sight.
SPACES = (
    "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), "
    "chr(31), chr(133), chr(160), chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), "
    "chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201), chr(8202), "
    "chr(8232), chr(8233), chr(8239), chr(8287), chr(12288))"
)
DB2 = r"^(\d{4}-\d{2}-\d{2})-(\d{2})\.(\d{2})\.(\d{2})\.(\d+)$"
NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def cleaned(c: str) -> str:
    return (
        f"CASE WHEN {c} NOT IN {_in(NULL_TOKENS)} AND trim({c}, {SPACES}) NOT IN "
        f"{_in(BLANK_AFTER_TRIM)} THEN trim({c}, {SPACES}) END"
    )


def moment(c: str) -> str:
    parsed = f"TRY_CAST(regexp_replace({c}, '{DB2}', '\\1 \\2:\\3:\\4.\\5') AS TIMESTAMP)"
    return (
        f"CASE WHEN {parsed} BETWEEN TIMESTAMP '1677-09-22' AND TIMESTAMP '2262-04-11' "
        f"THEN {parsed} END"
    )


def whole(c: str) -> str:
    t = f"trim({c})"
    return (
        rf"CASE WHEN regexp_full_match({t}, '[+-]?\d+') THEN TRY_CAST({t} AS BIGINT) "
        f"WHEN regexp_full_match({t}, '{NUMBER}') AND TRY_CAST({t} AS DOUBLE) = "
        f"floor(TRY_CAST({t} AS DOUBLE)) THEN CAST(TRY_CAST({t} AS DOUBLE) AS BIGINT) END"
    )


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{NUMBER}') THEN TRY_CAST({c} AS DOUBLE) END"


def flag(c: str, default: str = "0") -> str:
    t = f"upper(trim({c}))"
    return (
        f"CAST(CASE WHEN {t} IN ('S', 'SI', '1') THEN 1 WHEN {t} IN ('N', 'NO', '0') THEN 0 "
        f"ELSE {default} END AS BIGINT)"
    )


def half_even(x: str, digits: int) -> str:
    scale = f"{float(10**digits)}"
    return f"round_even({x} * {scale}, 0) / {scale}"


# --- histories ----------------------------------------------------------------

PLAIN = """
SELECT o_custkey AS p, o_orderkey AS id, o_orderdate AS s,
       COALESCE(CASE WHEN o_orderkey % 7 = 0
                     THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END,
                CASE WHEN o_orderkey % 50 <> 0
                     THEN o_orderdate + to_days(CAST(o_orderkey % 120 AS INTEGER)) END) AS e
FROM orders
"""

# Written with last_day, so that it shares no form with the Spark expression.
CONTINUES = (
    "({f} + INTERVAL 1 DAY = {s} OR (day({f}) >= day(last_day(CAST({f} AS DATE))) - 2 "
    "AND CAST({s} AS DATE) = last_day(CAST({f} AS DATE)) + 1))"
)


def islands(source: str) -> str:
    """CTEs ending in ``island``: contracts with their period number."""
    joined = CONTINUES.format(f="prev", s="s")
    return f"""
    c AS (SELECT p, id, s, COALESCE(e, {FAR}) AS e FROM ({source}) src),
    m AS (SELECT *, max(e) OVER (PARTITION BY p ORDER BY s, id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c),
    n AS (SELECT *, CASE WHEN prev IS NULL OR NOT (prev >= s OR {joined})
                    THEN 1 ELSE 0 END AS opens FROM m),
    island AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY p ORDER BY s, id) AS BIGINT) AS isl
               FROM n)"""


def period_rows(source: str) -> str:
    """CTEs ending in ``period``."""
    return f"""{islands(source)},
    period AS (
      SELECT p, min(s) AS s, nullif(max(e), {FAR}) AS f, count(*) AS n,
             string_agg(CAST(id AS VARCHAR), ',' ORDER BY s, id) AS ids
      FROM island GROUP BY p, isl)"""


def periods_query(source: str) -> str:
    return f"""WITH {period_rows(source)}
    SELECT p AS "IDPERSONA", s AS "PERIODO_INICIO", f AS "PERIODO_FIN",
           f IS NULL AS "PERIODO_VIGENTE",
           date_diff('day', s, COALESCE(f, {AS_OF})) + 1 AS "PERIODO_DURACION_DIAS",
           n AS "N_CONTRATOS", ids AS "IDCONTRATOLABORAL"
    FROM period"""


# One contract at a time, the way the rules are written down.
INVERTED = f"""WITH RECURSIVE c AS (
  SELECT o_custkey AS p, o_orderkey AS id, o_orderdate AS s,
         o_orderdate + to_days(CAST(o_orderkey % 120 - 20 AS INTEGER)) AS e,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders),
walk AS (
  SELECT p, rn, 1 AS isl, s AS first, e AS f, CAST(id AS VARCHAR) AS ids, id FROM c WHERE rn = 1
  UNION ALL
  SELECT c.p, c.rn,
         CASE WHEN w.f >= c.s OR {CONTINUES.format(f="w.f", s="c.s")} THEN w.isl ELSE w.isl + 1 END,
         c.s,
         CASE WHEN w.f >= c.s THEN greatest(w.f, c.e) ELSE c.e END,
         CAST(c.id AS VARCHAR), c.id
  FROM walk w JOIN c ON c.p = w.p AND c.rn = w.rn + 1)
SELECT p AS "IDPERSONA", min(first) AS "PERIODO_INICIO", arg_max(f, rn) AS "PERIODO_FIN",
       FALSE AS "PERIODO_VIGENTE",
       date_diff('day', min(first), arg_max(f, rn)) + 1 AS "PERIODO_DURACION_DIAS",
       count(*) AS "N_CONTRATOS", string_agg(ids, ',' ORDER BY rn) AS "IDCONTRATOLABORAL"
FROM walk GROUP BY p, isl"""


def _mode(name: str, value: str, condition: str = "TRUE") -> str:
    return f"""
    {name} AS (SELECT p, v FROM (
      SELECT p, {value} AS v, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, {value}) AS r
      FROM w WHERE {value} IS NOT NULL AND {condition} GROUP BY p, {value}) WHERE r = 1)"""


def feature_rows(source: str) -> str:
    """CTEs ending in ``feature``: the contract features without pay."""
    years = half_even("COALESCE(sum(days) FILTER (WHERE role = '{}'), 0) / 365.25", 2)
    finished = half_even(
        "avg(CASE WHEN state = 'FF' THEN 1.0 ELSE 0.0 END) "
        "FILTER (WHERE move = 'V' AND state IS NOT NULL)",
        2,
    )
    return f"""
    w AS (SELECT *, row_number() OVER o AS rn, lag(cargo) OVER o AS pc, lag(rmu) OVER o AS pr,
                 date_diff('day', s, COALESCE(e, {AS_OF})) + 1 AS days
          FROM ({source}) src WINDOW o AS (PARTITION BY p ORDER BY s, id)),
    {_mode("mc", "cargo")}, {_mode("md", "ded", "role = 'DOCENTE'")},
    multi AS (SELECT p, max(n) > 1 AS several FROM (
      SELECT p, year(s), count(DISTINCT cargo) AS n FROM w GROUP BY ALL) GROUP BY p),
    plain AS (
      SELECT p,
        count(*) AS "N_REGISTROS_HISTORIAL",
        count(*) FILTER (WHERE NOT (cargo = pc OR (cargo IS NULL AND pc IS NULL))
                         OR rmu IS DISTINCT FROM pr) AS "N_CONTRATOS_TOTAL",
        count(DISTINCT cargo) AS "N_CARGOS_DISTINTOS",
        arg_max_null(cargo, rn) AS "CARGO_ACTUAL",
        count(DISTINCT unit_id) AS "N_UNIDADES_DISTINTAS",
        arg_max_null(unit, rn) AS "UNIDAD_ACTUAL_NOMBRE",
        count(DISTINCT unit) FILTER (WHERE upper(unit) LIKE '%FACULTAD%')
          AS "N_FACULTADES_DISTINTAS",
        COALESCE(bool_or(upper(unit) LIKE '%RECTORADO%'), FALSE) AS "PASO_POR_RECTORADO",
        count(DISTINCT regime) AS "N_REGIMENES_DISTINTOS",
        arg_min_null(regime, rn) AS "REGIMEN_INICIAL_DESC",
        arg_max_null(regime, rn) AS "REGIMEN_ACTUAL_DESC",
        arg_max_null(role, rn) AS "TIPOEMPLEADO_ACTUAL_DESC",
        count(DISTINCT role) > 1 AS "ES_DOCENTE_ADMIN_MIXTO",
        {years.format("DOCENTE")} AS "ANIOS_EXPERIENCIA_DOCENTE",
        {years.format("ADMINISTRATIVO")} AS "ANIOS_EXPERIENCIA_ADMINISTRATIVO",
        arg_max(ded, rn) FILTER (WHERE role = 'DOCENTE') AS "DEDICACION_DOCENTE_ACTUAL",
        count(DISTINCT ded) FILTER (WHERE role = 'DOCENTE')
          AS "N_DEDICACIONES_DOCENTE_DISTINTAS",
        {finished} AS "PROPORCION_CONTRATOS_FINALIZADOS"
      FROM w GROUP BY p),
    feature AS (
      SELECT plain.p AS "IDPERSONA", plain.* EXCLUDE (p), mc.v AS "CARGO_MAS_FRECUENTE",
             several AS "MULTIPLES_CARGOS_MISMO_ANIO", md.v AS "DEDICACION_DOCENTE_MAS_FRECUENTE"
      FROM plain LEFT JOIN mc USING (p) LEFT JOIN md USING (p) LEFT JOIN multi USING (p))"""


def tenure_rows() -> str:
    """A CTE ``tenure`` over ``period``."""
    effective = half_even('CAST("ANTIGUEDAD_EFECTIVA_DIAS" AS DOUBLE) / 365.25', 2)
    calendar = half_even('CAST("ANTIGUEDAD_CALENDARIO_DIAS" AS DOUBLE) / 365.25', 2)
    return f"""
    sums AS (
      SELECT p AS "IDPERSONA", min(s) AS "FECHA_PRIMER_INGRESO",
             max(COALESCE(f, {AS_OF})) AS "FECHA_ULTIMO_PERIODO_FIN",
             count(*) AS "N_PERIODOS_CONTINUOS",
             CAST(sum(date_diff('day', s, COALESCE(f, {AS_OF})) + 1) AS BIGINT)
               AS "ANTIGUEDAD_EFECTIVA_DIAS",
             bool_or(f IS NULL) AS "VIGENTE_ACTUALMENTE",
             date_diff('day', min(s), max(COALESCE(f, {AS_OF}))) + 1 AS "ANTIGUEDAD_CALENDARIO_DIAS",
             count(*) - 1 AS "N_REINGRESOS"
      FROM period GROUP BY p),
    tenure AS (SELECT *, {effective} AS "ANTIGUEDAD_EFECTIVA_ANIOS",
                      {calendar} AS "ANTIGUEDAD_CALENDARIO_ANIOS" FROM sums)"""


PAY = f"""WITH w AS (
  SELECT *, row_number() OVER (PARTITION BY p ORDER BY s, id) AS rn,
         last_value(rmu IGNORE NULLS) OVER (PARTITION BY p ORDER BY s, id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
  FROM ({HISTORY_SQL}) src),
g AS (SELECT p, arg_min(rmu, rn) AS a, arg_max(rmu, rn) AS b, min(rmu) AS lo, max(rmu) AS hi,
             avg(rmu) AS mean, count(rmu) AS n, count(*) FILTER (WHERE rmu <> known) AS steps
      FROM w GROUP BY p)
SELECT p AS "IDPERSONA", a AS "RMU_INICIAL", b AS "RMU_ACTUAL", lo AS "RMU_MIN", hi AS "RMU_MAX",
       {half_even("mean", 2)} AS "RMU_PROMEDIO", b - a AS "RMU_CRECIMIENTO_ABS",
       {half_even("(b - a) / nullif(a, 0) * 100", 2)} AS "RMU_CRECIMIENTO_PCT",
       CASE WHEN n > 0 THEN steps END AS "N_CAMBIOS_RMU"
FROM g"""


# --- raw extracts -------------------------------------------------------------

CASES = {
    "area": {"DI": "Disciplinar", "PE": "Pedagógica", "OT": "Otra"},
    "form": {
        "R": "PARTICIPANTES-RECIBIDOS", "I": "INSTRUCTOR-IMPARTIDOS", "A": "ASISTENCIA",
        "P": "PRESENTACION",
    },
    "category": {"PC": "POR CLASIFICAR", "AD": "ADMINISTRATIVA", "AC": "ACADEMICA"},
    "role": {"PR": "PROFESOR", "FA": "FACILITADOR", "PA": "PERSONAL DE APOYO", "AY": "AYUDANTE"},
}


def described(c: str, dictionary: dict[str, str], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dictionary.items())
    return f"CASE {c} {whens} ELSE {otherwise} END"


def _typed(cell: Cell) -> list[str]:
    c = f'"{cell.name}"'
    kinds = {"text": c, "int": whole(c), "ts": moment(c), "flag": flag(c), "number": number(c)}
    if cell.kind in kinds:
        return [f"{kinds[cell.kind]} AS {c}"]
    coded = CASES[cell.kind]
    if cell.kind in ("category", "role"):
        return [c, f'{described(c, coded)} AS "{cell.name}_DESC"']
    return [f"{described(c, coded, c if cell.kind == 'form' else 'NULL')} AS {c}"]


def source_query(output: str) -> str:
    cells = CELLS[output]
    kept = [c for c in cells if not c.gone]
    texts = ", ".join(f'{cleaned(chr(34) + c.name + chr(34))} AS "{c.name}"' for c in cells)
    listed = [x for c in kept for x in _typed(c)]
    distinct = "DISTINCT " if output in DEDUPED else ""
    if output == "carga_politecnica_disponible":
        on = [f'("TERMINO{i}" IS NOT NULL)' for i in (1, 2, 3)]
        for i, term in enumerate(on, start=1):
            listed.append(f'CAST({term} AS INTEGER) AS "APLICA_T{i}"')
        listed.append(" + ".join(f"CAST({t} AS INTEGER)" for t in on) + ' AS "NUM_TERMINOS"')
        names = ", ".join(f"CASE WHEN {t} THEN '{i}' END" for i, t in enumerate(on, start=1))
        active = f"COALESCE(nullif(concat_ws('-', {names}), ''), 'SIN_TERMINO')"
        listed.append(f'{active} AS "TERMINOS_ACTIVOS"')
    query = f"SELECT {distinct}{', '.join(listed)} FROM (SELECT {texts} FROM ({raw_sql(output)}) r) c"
    if output == "datos_personales_ultimos_5anios":
        born = '"FECHANACIMIENTO"'
        days = f"floor(date_diff('hour', date_trunc('hour', {born}), TIMESTAMP '2026-08-31') / 24.0)"
        # Only midnight and 10:11:12 occur, and the reference day is a midnight.
        late = f"CASE WHEN {born} > date_trunc('day', {born}) THEN 1 ELSE 0 END"
        days = f"date_diff('day', {born}, TIMESTAMP '2026-08-31') - {late}"
        query = f'SELECT *, CAST(floor(({days}) / 365.25) AS BIGINT) AS "EDAD" FROM ({query}) q'
    return query


HISTORY_TABLE = f"""SELECT id AS "IDCONTRATOLABORAL", p AS "IDPERSONA", s AS "FECHAINICIOCONTRATO",
  CASE WHEN id % 50 <> 0 THEN s + to_days(CAST(id % 120 AS INTEGER)) END AS "FECHAFINCONTRATO",
  CASE WHEN id % 7 = 0 THEN s + to_days(CAST(id % 30 AS INTEGER)) END AS "FECHADESVINCULACION",
  cargo AS "CARGO", rmu AS "RMU", unit AS "NOMBRE_UNIDAD",
  CAST(unit_id AS BIGINT) AS "IDESTRUCTURAORGANICA",
  CASE role WHEN 'DOCENTE' THEN 'DD' WHEN 'ADMINISTRATIVO' THEN 'AA' END AS "TIPOEMPLEADO",
  CAST(id % 10 AS VARCHAR) AS "IDREGIMENLABORAL", ded AS "TIPODEDICACION",
  state AS "ESTADOCONTRATO", move AS "TIPO", 'CONTRATOS' AS "NOMBRETABLA",
  role AS "TIPOEMPLEADO_DESC", regime AS "IDREGIMENLABORAL_DESC"
FROM ({HISTORY_FILLED_SQL}) src"""


# --- smaller queries ----------------------------------------------------------

FLAGS = (
    "CASE event_id % 7 WHEN 0 THEN 'S' WHEN 1 THEN ' si ' WHEN 2 THEN 'N' WHEN 3 THEN 'no' "
    "WHEN 4 THEN '1' WHEN 5 THEN 'x' END"
)
NUMBERS = (
    "CASE WHEN o_orderkey % 5 = 0 THEN concat(o_orderkey, '.0') "
    "WHEN o_orderkey % 7 = 0 THEN 'abc' "
    "WHEN o_orderkey % 11 = 0 THEN concat('  ', o_orderkey, ' ') "
    "WHEN o_orderkey % 13 = 0 THEN '1d' WHEN o_orderkey % 17 = 0 THEN concat(o_orderkey, '.5') "
    "WHEN o_orderkey % 19 = 0 THEN concat('90071992547', lpad(CAST(o_orderkey AS VARCHAR), 7, '0')) "
    "WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderkey AS VARCHAR) END"
)
WIDE = (
    "SELECT *, 'x' AS fixed, CASE WHEN c_custkey % 10 < 2 THEN c_custkey END AS fifth FROM customer"
)


def bins(source: str, n: int, clip: float | None) -> str:
    """``n`` equal bins of ``x``, bounds compared directly with each bin's edges."""
    limit = f"WHERE x <= (SELECT quantile_cont(x, {clip}) FROM src)" if clip else ""
    return f"""WITH src AS ({source}),
    d AS (SELECT x FROM src {limit}),
    m AS (SELECT CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0.0 END AS w FROM d),
    b AS (SELECT min(x) - any_value(w) AS lo, max(x) + any_value(w) AS hi FROM d, m),
    e AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / {n}) AS lower,
                 CASE WHEN i = {n} - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / {n}) END AS upper
          FROM b, range({n}) t(i))
    SELECT bin, any_value(lower) AS lower, any_value(upper) AS upper, count(x) AS n
    FROM e LEFT JOIN d ON x >= lower AND (x < upper OR (bin = {n} - 1 AND x <= upper))
    GROUP BY bin"""


# Kind, column and size of each source's charts. A histogram's size is
# its bins and, unless all values count, the quantile it ends at.
CHARTS = {
    "capacitaciones_todas": "year FECHAINICIO, top TIPOEVENTODESCRIPCION 10, per_key IDPERSONA 30 0.99",
    "carga_academica_disponible": "histogram NUMREGISTRADOS 30 0.99, top NOMBREUNIDAD 10",
    "carga_politecnica_disponible": "counts ANIO, top NOMBREUNIDAD 10, counts NUM_TERMINOS",
    "catalogo_actividades_carga": "top ACTIVIDAD 10, top DURACIONTIPO 19",
    "certificados_todos": "year FECHAINICIO, top CERTIFICADOPOR 10, top TIPOMODALIDADDESCRIPCION 15",
    "datos_personales_ultimos_5anios": "histogram EDAD 25, top SEXO 15, top ESTADOCIVIL 15, top PROVINCIAORIGEN 10",
    "experiencia_externa": "top CATEXPERIENCIA_DESC 15, top ROLACADEMICO_DESC 15, histogram DURACION_ANIOS 30 0.99, top PAIS 10",
    "heteroevaluacion_disponible": "histogram PROMEDIO 30, counts ANIO, top UNIDAD 10, histogram TASA_PARTICIPACION 30",
    "idiomas_personas": "top IDIOMA 12, top NIVELLECTURA 15, counts LENGUANATIVA",
    "mencion_honor": "year FECHA, top INSTITUCION 10, top TIPO 15",
    "ponentes_todos": "year FECHAINICIO, top NOMBREPAIS 10, top TIPOMODALIDADDESCRIPCION 15, histogram DURACION 30 0.99",
    "proyecto_grado": "year FECHASUSTENTACION, top NOMBREPROGRAMA 10, top NIVELFORMACION 15",
    "proyectos_investigacion_disponible": "year FECHAINICIO, top STRTIPO 15, top STRAREACAMPOAMPLIO 10, top INSTITUCION_EXTERNA 10",
    "proyectos_vinculacion_disponible": "year FECHAINICIO, top NOMBREPROGRAMA 10, top ROLPROYECTO 15",
    "publicaciones": "counts ANIO, top TIPOPUBLICACION 10, top CUARTIL 15",
    "reporte_titulaciones_educacion": "year FechaGraduacion, top Nivel 15, top Institucion 10, top Pais 10",
}
CHART_VALUES = {
    "DURACION_ANIOS": (
        '(date_diff(\'day\', CAST("FECHADESDE" AS DATE), CAST("FECHAHASTA" AS DATE)) - CASE WHEN '
        'CAST("FECHAHASTA" AS TIME) < CAST("FECHADESDE" AS TIME) THEN 1 ELSE 0 END) / 365.25'
    ),
    "TASA_PARTICIPACION": 'CASE WHEN "REGISTRADOS" <> 0 THEN "EVALUADOS" / "REGISTRADOS" END',
}


def _chart(kind: str, name: str, *size: str) -> str:
    c = f'"{name}"'
    label = f"'{kind}:{name}' AS chart"
    if kind == "year":
        return f"SELECT {label}, CAST(year({c}) AS VARCHAR) AS key, count(*) AS n FROM cleaned WHERE {c} IS NOT NULL GROUP BY 2"
    if kind == "counts":
        return f"SELECT {label}, CAST({c} AS VARCHAR) AS key, count(*) AS n FROM cleaned WHERE {c} IS NOT NULL GROUP BY 2"
    if kind == "top":
        return (
            f"SELECT * FROM (SELECT {label}, {c} AS key, count(*) AS n FROM cleaned "
            f"WHERE {c} <> '' GROUP BY 2 ORDER BY n DESC, key LIMIT {size[0]})"
        )
    if kind == "per_key":
        source = f"SELECT CAST(count(*) AS DOUBLE) AS x FROM cleaned WHERE {c} IS NOT NULL GROUP BY {c}"
    else:
        source = f"SELECT CAST(x AS DOUBLE) AS x FROM (SELECT {CHART_VALUES.get(name, c)} AS x FROM cleaned) WHERE x IS NOT NULL"
    binned = bins(source, int(size[0]), float(size[1]) if len(size) > 1 else None)
    return f"SELECT {label}, CAST(bin AS VARCHAR) AS key, n FROM ({binned})"


def charts_query(output: str) -> str:
    parts = [_chart(*chart.split()) for chart in CHARTS[output].split(", ")]
    return f"WITH cleaned AS MATERIALIZED ({source_query(output)}) " + " UNION ALL ".join(parts)


def summary_query(output: str) -> str:
    cells = ", ".join(
        f'CASE WHEN "{c.name}" NOT IN {_in(NULL_TOKENS)} THEN "{c.name}" END AS "{c.name}"'
        for c in CELLS[output]
    )
    stages = {
        "before": f"SELECT {cells} FROM ({raw_sql(output)}) r",
        "after": source_query(output),
    }
    parts = [
        f"SELECT (SELECT count(*) FROM ({sql})) AS rows, CAST((SELECT count(*) FROM "
        f"(DESCRIBE {sql})) AS INTEGER) AS columns, (SELECT count(*) FROM ({sql})) - "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({sql}))) AS duplicate_rows, '{stage}' AS stage"
        for stage, sql in stages.items()
    ]
    return " UNION ALL ".join(parts)


def _percent(c: str) -> str:
    return half_even(f"(1 - count({c}) / count(*)) * 100", 1)


ORACLES: dict[str, str] = {
    "continuous_periods": periods_query(PLAIN),
    "continuous_periods_inverted": INVERTED,
    "continuous_periods_hot": periods_query(PLAIN),
    "contract_periods": f"""WITH {islands(PLAIN)}
        SELECT p AS "IDPERSONA", isl AS "PERIODO", id AS "IDCONTRATOLABORAL",
               s AS "FECHAINICIOCONTRATO" FROM island""",
    "month_cut_gaps": f"""SELECT {CONTINUES.format(f="o_orderdate", s="l_shipdate")} AS continues,
        count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "period_count_distribution": f"""WITH {period_rows(PLAIN)}
        SELECT n_periodos_continuos, count(*) AS n_personas
        FROM (SELECT count(*) AS n_periodos_continuos FROM period GROUP BY p) GROUP BY 1""",
    "person_features": f"WITH {feature_rows(HISTORY_SQL)} SELECT * FROM feature",
    "person_features_hot": f"WITH {feature_rows(HISTORY_SQL)} SELECT * FROM feature",
    "person_features_rmu": PAY,
    "person_tenure": f"""WITH {period_rows(PLAIN)}, {tenure_rows()},
        r AS (SELECT o_custkey AS "IDPERSONA", count(*) AS "N_REGISTROS_HISTORIAL",
                     count(*) AS "N_CONTRATOS_TOTAL" FROM orders GROUP BY 1)
        SELECT * FROM r LEFT JOIN tenure USING ("IDPERSONA")""",
    "change_count": f"""WITH w AS (
        SELECT *, lag(cargo) OVER o AS pc, lag(rmu) OVER o AS pr, row_number() OVER o AS rn
        FROM ({HISTORY_SQL}) src WINDOW o AS (PARTITION BY p ORDER BY s, id))
        SELECT p AS "IDPERSONA",
          count(*) FILTER (WHERE NOT (cargo = pc OR (cargo IS NULL AND pc IS NULL))
                           OR rmu IS DISTINCT FROM pr) AS changes,
          count(*) FILTER (WHERE rn = 1 OR cargo IS DISTINCT FROM pc OR rmu IS DISTINCT FROM pr)
            AS changes_null_safe
        FROM w GROUP BY p""",
    "clean_strings": f"""SELECT doc_id, md5(trim(text, {SPACES})) AS text_md5,
        CASE WHEN doc_id % 4 > 1 THEN lang END AS lang FROM documents""",
    "null_tokens": f"""WITH t AS (SELECT CASE event_id % 6 WHEN 0 THEN 'NULL' WHEN 1 THEN 'N/A'
        WHEN 2 THEN 'null' WHEN 3 THEN 'none' ELSE event_type END AS s FROM events)
        SELECT CASE WHEN s NOT IN {_in(NULL_TOKENS)} THEN s END AS spelled, count(*) AS n
        FROM t GROUP BY 1""",
    "fill_missing_text": """SELECT p_partkey,
        CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE 'DESCONOCIDA' END AS p_name FROM part""",
    "repair_text": "SELECT p_partkey, p_name FROM part",
    "collapse_repeated": "SELECT c_custkey, c_name AS name, c_nationkey AS nation FROM customer",
    "null_and_constant_profile": f"""WITH u AS (
        SELECT unnest([
          {{'c': 'c_custkey', 'r': avg((c_custkey IS NULL)::INT), 'd': count(DISTINCT c_custkey)}},
          {{'c': 'c_name', 'r': avg((c_name IS NULL)::INT), 'd': count(DISTINCT c_name)}},
          {{'c': 'c_nationkey', 'r': avg((c_nationkey IS NULL)::INT),
            'd': count(DISTINCT c_nationkey)}},
          {{'c': 'c_acctbal', 'r': avg((c_acctbal IS NULL)::INT), 'd': count(DISTINCT c_acctbal)}},
          {{'c': 'c_mktsegment', 'r': avg((c_mktsegment IS NULL)::INT),
            'd': count(DISTINCT c_mktsegment)}},
          {{'c': 'fixed', 'r': avg((fixed IS NULL)::INT), 'd': 2}},
          {{'c': 'fifth', 'r': avg((fifth IS NULL)::INT), 'd': count(DISTINCT fifth)}},
          {{'c': 'never', 'r': 1.0, 'd': 0}}]) AS x FROM ({WIDE}) t)
        SELECT x.c AS column_name, x.r AS null_ratio, x.r >= 0.8 AS is_sparse,
               x.d <= 1 AS is_constant FROM u""",
    "surviving_columns": "SELECT *, 'y' AS protected FROM customer",
    "dedupe_rows": "SELECT DISTINCT p_name, p_brand, p_type FROM part",
    "rows_removed": """SELECT count(*) AS rows_before,
        count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS rows_after,
        count(*) - count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS rows_removed
        FROM lineitem""",
    "parse_dates": f"""WITH t AS (SELECT o_orderkey, CASE
          WHEN o_orderkey % 5 = 0
            THEN concat(strftime(o_orderdate, '%Y-%m-%d'), '-10.11.12.123456')
          WHEN o_orderkey % 7 = 0 THEN '2010-02-30' WHEN o_orderkey % 11 = 0 THEN '9999-12-31'
          WHEN o_orderkey % 13 = 0 THEN 'bad'
          WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS m FROM orders)
        SELECT o_orderkey, {moment("m")} AS moment FROM t""",
    "parse_ints": f"""SELECT o_orderkey, {whole("x")} AS number
        FROM (SELECT o_orderkey, {NUMBERS} AS x FROM orders)""",
    "parse_numbers": f"""SELECT o_orderkey, {number("x")} AS number
        FROM (SELECT o_orderkey, {NUMBERS} AS x FROM orders)""",
    "yes_no_binary": f"""SELECT event_id, {flag("x")} AS flag, {flag("x", "NULL")} AS flag_or_null
        FROM (SELECT event_id, {FLAGS} AS x FROM events)""",
    "yes_no_detected": f"""SELECT event_id,
        CAST(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS BIGINT) AS clean_flag,
        {FLAGS} AS dirty_flag, CAST(NULL AS VARCHAR) AS no_values FROM events""",
    "decode_strict": """SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'OPEN' END AS status
        FROM orders""",
    "decode_passthrough": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FINISHED'
        WHEN 'O' THEN 'OPEN' ELSE o_orderstatus END AS status FROM orders""",
    "decode_or_blank": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PRESENCIAL'
        WHEN o_orderstatus = 'F' THEN 'VIRTUAL' ELSE '' END AS mode FROM orders""",
    "describe_experience": """SELECT event_id,
        ['PC', 'AD', 'AC', 'ZZ'][event_id % 4 + 1] AS "CATEXPERIENCIA",
        ['PR', 'FA', 'PA', 'AY', NULL][event_id % 5 + 1] AS "ROLACADEMICO",
        ['POR CLASIFICAR', 'ADMINISTRATIVA', 'ACADEMICA', NULL][event_id % 4 + 1]
          AS "CATEXPERIENCIA_DESC",
        ['PROFESOR', 'FACILITADOR', 'PERSONAL DE APOYO', 'AYUDANTE', NULL][event_id % 5 + 1]
          AS "ROLACADEMICO_DESC" FROM events""",
    "describe_contracts": f"""SELECT
        CASE role WHEN 'DOCENTE' THEN 'DD' WHEN 'ADMINISTRATIVO' THEN 'AA' END AS "TIPOEMPLEADO",
        role AS "TIPOEMPLEADO_DESC", CAST(id % 10 AS VARCHAR) AS "IDREGIMENLABORAL",
        regime AS "IDREGIMENLABORAL_DESC", count(*) AS n FROM ({HISTORY_SQL}) src GROUP BY ALL""",
    "unmapped_codes": """SELECT DISTINCT o_orderstatus FROM orders
        WHERE o_orderstatus NOT IN ('F', 'O')""",
    "unmapped_catalogue_codes": """SELECT DISTINCT l_partkey + l_linenumber - 1 AS p_partkey
        FROM lineitem WHERE l_partkey + l_linenumber - 1 NOT IN (SELECT p_partkey FROM part)""",
    "catalog_decode": """SELECT c_custkey, n_name, r_name FROM customer
        LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "subset_check": """SELECT c_custkey, c_name FROM customer
        WHERE c_custkey NOT IN (SELECT 2 * o_custkey FROM orders)""",
    "event_subset": """SELECT event_id, event_type, value FROM events
        WHERE event_type = 'signup' AND value <= 5""",
    "correction_overlay": """SELECT o_orderkey, COALESCE(fixed, CASE o_orderkey WHEN 1 THEN 10.0
          WHEN 2 THEN 20.0 END, o_totalprice) AS o_totalprice
        FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS fixed FROM lineitem
          GROUP BY 1 HAVING count(*) >= 5) ON l_orderkey = o_orderkey""",
    "active_term_list": """WITH t AS (SELECT p_partkey, CAST(p_partkey % 2 = 0 AS INTEGER) AS a1,
        CAST(p_partkey % 3 <> 0 AS INTEGER) AS a2, 0 AS a3 FROM part)
        SELECT *, a1 + a2 + a3 AS n_terms,
          CASE WHEN a1 + a2 = 0 THEN 'SIN_TERMINO' WHEN a2 = 0 THEN '1' WHEN a1 = 0 THEN '2'
               ELSE '1-2' END AS terms FROM t""",
    "age_years": """SELECT o_orderkey, CAST(floor(date_diff('day', o_orderdate,
        TIMESTAMP '2026-08-31') / 365.25) AS BIGINT) AS age FROM orders""",
    "duration_and_ratio": """SELECT l_orderkey, l_linenumber, l_shipdate,
        date_diff('day', o_orderdate, l_shipdate) / 365.25 AS years,
        l_quantity / nullif(l_tax, 0) AS share
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "event_gap_days": """SELECT event_id, CAST(floor(
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 86400000000.0) AS INTEGER)
        AS days FROM events""",
    "table_summary": """SELECT count(*) AS rows, 4 AS columns,
        count(*) - count(DISTINCT (text, lang, source, n_chars)) AS duplicate_rows
        FROM documents""",
    "null_percentages": f"""WITH t AS (SELECT
          CASE WHEN o_orderkey % 7 <> 0 THEN 1 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS b,
          CASE WHEN o_orderkey % 50 <> 0 THEN 1 END AS c FROM orders),
        u AS (SELECT unnest([
          {{'n': 'o_orderdate', 'p': {_percent("a")}}}, {{'n': 'o_totalprice', 'p': {_percent("b")}}},
          {{'n': 'o_orderstatus', 'p': {_percent("c")}}}]) AS x FROM t)
        SELECT x.n AS column_name, x.p AS null_pct FROM u""",
    "value_counts": "SELECT role, count(*) AS n FROM conversations GROUP BY 1",
    "value_counts_with_nulls": """SELECT nullif(o_orderstatus, 'P') AS status, count(*) AS n
        FROM orders GROUP BY 1""",
    "value_counts_in_order": "SELECT p_size, count(*) AS n FROM part GROUP BY 1",
    "topk_values": """SELECT p_name, count(*) AS n FROM part WHERE p_partkey % 9 <> 0
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "rows_per_year": """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n
        FROM lineitem GROUP BY 1""",
    "rows_per_person": bins(
        "SELECT CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY o_custkey", 30, 0.99
    ),
    "histogram_bins": bins("SELECT value AS x FROM events", 30, 0.99),
    "histogram_unclipped": bins("SELECT l_extendedprice AS x FROM lineitem", 25, None),
    "iqr_outliers": f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS a,
          quantile_cont(value, 0.75) AS b FROM events),
        l AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
        SELECT event_id, user_id, value, {half_even("lo", 4)} AS low, {half_even("hi", 4)} AS high
        FROM events, l WHERE value < lo OR value > hi""",
    "iqr_outlier_count": """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a,
          quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
        SELECT count(*) FILTER (WHERE l_extendedprice < a - 0.5 * (b - a)
          OR l_extendedprice > b + 0.5 * (b - a)) AS outliers, count(*) AS n FROM lineitem, q""",
    "describe_numeric": f"""SELECT count(o_totalprice) AS count,
        {half_even("avg(o_totalprice)", 3)} AS mean,
        {half_even("stddev_samp(o_totalprice)", 3)} AS std,
        {half_even("min(o_totalprice)", 3)} AS min,
        {half_even("quantile_cont(o_totalprice, 0.25)", 3)} AS p25,
        {half_even("quantile_cont(o_totalprice, 0.5)", 3)} AS p50,
        {half_even("quantile_cont(o_totalprice, 0.75)", 3)} AS p75,
        {half_even("max(o_totalprice)", 3)} AS max FROM orders""",
    "quantiles_narrowed": f"""WITH v AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'inf'::DOUBLE
          WHEN event_id % 60 = 1 THEN '-inf'::DOUBLE WHEN event_id % 7 = 2 THEN NULL
          WHEN event_id % 9 <> 3 THEN round(value, 1) END AS x FROM events),
        s AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM v WHERE x IS NOT NULL),
        p AS (SELECT unnest([0.0, 0.005, 0.25, 0.5, 0.75, 0.99, 1.0])::DOUBLE AS p),
        w AS (SELECT p, p * (SELECT count(*) - 1 FROM s) AS pos FROM p),
        q AS (SELECT p, pos, a.x AS lo, b.x AS hi FROM w JOIN s a ON a.i = floor(pos)
          JOIN s b ON b.i = ceil(pos)),
        r AS (SELECT p, CASE WHEN lo = hi THEN lo ELSE lo * (ceil(pos) - pos) + hi * (pos - floor(pos)) END AS x
          FROM q)
        SELECT p, CASE WHEN isinf(x) THEN x ELSE {half_even("x", 6)} END AS quantile FROM r""",
    "csv_messy_round_trip": """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE c_custkey % 4
          WHEN 0 THEN concat('5" pipe, ', c_name)
          WHEN 1 THEN concat(c_name, chr(10), chr(10), 'second, line', c_mktsegment)
          WHEN 2 THEN concat(c_name, chr(13), chr(10), '"quoted"', c_mktsegment)
          ELSE c_name END AS "the
note" FROM customer""",
    "csv_encodings": r"""SELECT doc_id, lang, concat(regexp_replace(coalesce(text, ''), '[^\x{00}-\x{ff}]', '', 'g'),
          CASE doc_id % 4 WHEN 0 THEN 'ñ' WHEN 1 THEN '€“' WHEN 2 THEN chr(129) ELSE '.' END) AS text,
        upper(lang) AS lang_again FROM documents""",
    **{f"summary_{output}": summary_query(output) for output in RAW},
    **{f"charts_{output}": charts_query(output) for output in CHARTS},
    "csv_round_trip": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
        c_acctbal, c_mktsegment, concat('say "', c_name, '",', c_mktsegment) AS note
        FROM customer""",
    **{f"source_{output}": source_query(output) for output in RAW},
    f"source_{HISTORY_OUTPUT}": HISTORY_TABLE,
    f"source_{PERIODS_OUTPUT}": periods_query(HISTORY_FILLED_SQL),
    f"source_{FEATURES_OUTPUT}": f"""WITH {feature_rows(HISTORY_FILLED_SQL)},
        {period_rows(HISTORY_FILLED_SQL)}, {tenure_rows()}
        SELECT * FROM feature LEFT JOIN tenure USING ("IDPERSONA")""",
}
