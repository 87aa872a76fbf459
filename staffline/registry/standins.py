"""Staff-like inputs derived from the test tables.

``HISTORY_SQL`` is the DuckDB twin of ``work_history``. Raw extracts are written
once, in SQL both engines read alike, see ``raw_sql``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staffline.functions import null_if_token
from staffline.operators.columns import apply_steps
from staffline.plans.sources import BY_OUTPUT
from staffline.session import spread

AS_OF = "2002-01-01"

K = "o_orderkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def contracts(spark: SparkSession, sf_dir: str, inverted: bool = False) -> DataFrame:
    """Orders as contracts of customers. ``inverted`` lets some end before they start."""
    k, start = F.col(K), F.col("o_orderdate")
    planned = F.when(k % 50 != 0, start + _days(k % 120))
    if inverted:
        planned = start + _days(k % 120 - 20)
    dates = {"FECHAINICIOCONTRATO": start, "FECHAFINCONTRATO": planned}
    if not inverted:
        dates["FECHADESVINCULACION"] = F.when(k % 7 == 0, start + _days(k % 30))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("IDPERSONA"),
        k.alias("IDCONTRATOLABORAL"),
        *(v.alias(n) for n, v in dates.items()),
        F.col("o_orderpriority").alias("CARGO"),
        F.col("o_totalprice").alias("RMU"),
        F.col("o_orderstatus").alias("_status"),
    )


def work_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with every column the person features use."""
    k, status = F.col("IDCONTRATOLABORAL"), F.col("_status")
    units = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("IDESTRUCTURAORGANICA"), "n_name"
    )
    unit = (
        F.when(k % 4 == 0, F.concat(F.lit("Facultad "), "n_name"))
        .when(k % 11 == 0, F.concat(F.lit("VICERRECTORADO "), "n_name"))
        .otherwise(F.col("n_name"))
    )
    return (
        contracts(spark, sf_dir)
        .withColumn("IDESTRUCTURAORGANICA", k % 25)
        .join(units, "IDESTRUCTURAORGANICA")
        .withColumns({
            "CARGO": F.when(k % 9 != 0, F.col("CARGO")),
            "RMU": F.when(k % 8 != 0, F.floor(F.col("RMU") / 100000).cast("double")),
            "NOMBRE_UNIDAD": unit,
            "TIPOEMPLEADO": F.when(status == "F", "DD").when(status == "O", "AA"),
            "IDREGIMENLABORAL": (k % 10).cast("string"),
            "TIPODEDICACION": F.when(k % 3 == 0, "TC").when(k % 3 == 1, "MT"),
            "ESTADOCONTRATO": F.when(status == "F", "FF").when(status == "O", "VI"),
            "TIPO": F.when(k % 5 == 0, "M").otherwise("V"),
        })
        .drop("n_name", "_status")
    )


HISTORY_SQL = """
SELECT o_custkey AS p, o_orderkey AS id, o_orderdate AS s,
       COALESCE(CASE WHEN o_orderkey % 7 = 0
                     THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END,
                CASE WHEN o_orderkey % 50 <> 0
                     THEN o_orderdate + to_days(CAST(o_orderkey % 120 AS INTEGER)) END) AS e,
       CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS cargo,
       CASE WHEN o_orderkey % 8 <> 0 THEN CAST(floor(o_totalprice / 100000) AS DOUBLE) END AS rmu,
       n_nationkey AS unit_id,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('Facultad ', n_name)
            WHEN o_orderkey % 11 = 0 THEN concat('VICERRECTORADO ', n_name)
            ELSE n_name END AS unit,
       CASE o_orderkey % 10 WHEN 0 THEN 'CONTRATO CIVIL'
            WHEN 7 THEN 'LOSEP - LEY ORGANICA DE SERVICIO PUBLICO'
            WHEN 8 THEN 'LOES - LEY ORGANICA DE EDUCACION SUPERIOR'
            WHEN 9 THEN 'CT - CODIGO DE TRABAJO' END AS regime,
       CASE o_orderstatus WHEN 'F' THEN 'DOCENTE' WHEN 'O' THEN 'ADMINISTRATIVO' END AS role,
       CASE o_orderkey % 3 WHEN 0 THEN 'TC' WHEN 1 THEN 'MT' END AS ded,
       CASE o_orderstatus WHEN 'F' THEN 'FF' WHEN 'O' THEN 'VI' END AS state,
       CASE WHEN o_orderkey % 5 = 0 THEN 'M' ELSE 'V' END AS move
FROM orders JOIN nation ON n_nationkey = o_orderkey % 25
"""


HISTORY_FILLED_SQL = HISTORY_SQL.replace(
    "ELSE n_name END AS unit", "WHEN o_orderkey % 6 = 5 THEN 'DESCONOCIDA' ELSE n_name END AS unit"
)


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work history as a raw extract: every cell text, dates in two spellings,
    some units unnamed, and columns the cleaning must drop."""
    history = work_history(spark, sf_dir)
    k, unit = F.col("IDCONTRATOLABORAL"), F.col("NOMBRE_UNIDAD")
    named = unit.startswith("Facultad") | unit.startswith("VICE") | (k % 6 != 5)
    values = {}
    for field in history.schema:
        c = F.col(field.name)
        if field.name.startswith("FECHA"):
            stamped = F.date_format(c, "yyyy-MM-dd-HH.mm.ss.SSSSSS")
            values[field.name] = F.when(k % 2 == 0, stamped).otherwise(
                F.date_format(c, "yyyy-MM-dd")
            )
        else:
            values[field.name] = F.concat(c.cast("string"), F.lit("  "))
    values["NOMBRE"] = F.when(named, values.pop("NOMBRE_UNIDAD"))
    values["NOMBRETABLA"] = F.lit("CONTRATOS")
    values["MODULO"] = F.concat(F.lit("m"), (k % 4).cast("string"))
    values["HORAS"] = (k % 40).cast("string")
    values["VACIA"] = F.lit(" ")
    return history.select(*(v.alias(n) for n, v in values.items()))


# --- raw extracts -------------------------------------------------------------


@dataclass(frozen=True)
class Cell:
    """A raw column: how it is written, and what becomes of it. ``kind`` is the type
    it is cast to; ``gone`` columns must be dropped by the cleaning."""

    name: str
    sql: str
    kind: str = "text"
    gone: bool = False


def _step(i: int) -> int:
    return 2 * i + 3


def whole(name: str, i: int = 1, holes: bool = True) -> Cell:
    n = f"(k * {_step(i)}) % 997"
    rare = f"WHEN k % 13 = {i % 13} THEN 'NA' WHEN k % 23 = {i % 23} THEN 'abc' " if holes else ""
    return Cell(
        name,
        f"CASE {rare}WHEN k % 17 = 3 THEN concat('  ', {n}, ' ') "
        f"WHEN k % 19 = 4 THEN concat({n}, '.0') ELSE concat('', {n}) END",
        "int",
    )


def stamp(name: str, i: int = 1, holes: bool = True) -> Cell:
    y, m, d = (f"(k * {_step(i)} + {i}) % {n}" for n in (30, 12, 28))
    day = (
        f"concat(1990 + {y}, '-', lpad(concat('', 1 + {m}), 2, '0'), '-', "
        f"lpad(concat('', 1 + {d}), 2, '0'))"
    )
    rare = f"WHEN k % 11 = {i % 11} THEN 'NULL' " if holes else ""
    return Cell(
        name,
        f"CASE {rare}WHEN k % 29 = 5 THEN '2010-02-30' WHEN k % 31 = 6 THEN '9999-12-31' "
        f"WHEN k % 3 = 1 THEN concat({day}, '-10.11.12.', '120456') ELSE {day} END",
        "ts",
    )


def flag(name: str, i: int = 1) -> Cell:
    return Cell(
        name,
        f"CASE (k + {i}) % 7 WHEN 0 THEN 'S' WHEN 1 THEN ' si ' WHEN 2 THEN 'N' "
        f"WHEN 3 THEN 'no' WHEN 4 THEN '1' WHEN 5 THEN 'x' END",
        "flag",
    )


def number(name: str, sql: str) -> Cell:
    return Cell(name, f"CASE WHEN k % 37 = 9 THEN 'n/a' ELSE concat('', {sql}) END", "number")


def text(name: str, sql: str, holes: bool = True) -> Cell:
    rare = "WHEN k % 15 = 7 THEN '   ' WHEN k % 16 = 8 THEN 'nan' " if holes else ""
    return Cell(name, f"CASE {rare}WHEN k % 5 = 2 THEN concat('  ', {sql}, '\t') ELSE {sql} END")


def empty(name: str) -> Cell:
    return Cell(name, "CASE WHEN k < 0 THEN 'x' END", gone=True)


def mostly_null(name: str, kept_in_10: int, gone: bool) -> Cell:
    return Cell(name, f"CASE WHEN k % 10 < {kept_in_10} THEN concat('v', k % 3) END", gone=gone)


def constant(name: str) -> Cell:
    return Cell(name, "CASE WHEN k % 2 = 0 THEN 'C' ELSE ' C ' END", gone=True)


def unused(name: str) -> Cell:
    return Cell(name, "concat('u', k % 50)", gone=True)


ORDERS = "SELECT o_orderkey AS k, o_orderpriority AS t1, o_orderstatus AS t2, o_totalprice AS v FROM orders"
CUSTOMERS = "SELECT c_custkey AS k, c_mktsegment AS t1, c_name AS t2, c_acctbal AS v FROM customer"
PARTS = "SELECT p_partkey AS k, p_name AS t1, p_type AS t2, p_retailprice AS v FROM part"
EVENTS = "SELECT event_id AS k, event_type AS t1, props AS t2, value AS v FROM events"
DOCUMENTS = "SELECT doc_id AS k, lang AS t1, text AS t2, n_chars AS v FROM documents"
LINES = (
    "SELECT l_orderkey * 8 + l_linenumber AS k, l_returnflag AS t1, l_linestatus AS t2, "
    "l_quantity AS v FROM lineitem"
)
TURNS = "SELECT conv_id * 100 + turn AS k, role AS t1, text AS t2, length(text) AS v FROM conversations"

# Output name -> base rows and raw columns.
RAW: dict[str, tuple[str, tuple[Cell, ...]]] = {
    "capacitaciones_todas": (EVENTS, (
        whole("IDCAPACITACION", 1), whole("IDPERSONA", 2), whole("IDCIUDAD", 3),
        stamp("FECHAINICIO", 1), stamp("FECHAAPROBACION", 4),
        Cell("AREACAPACITACIONDESCRIPCION",
             "CASE k % 4 WHEN 0 THEN 'DI' WHEN 1 THEN ' PE' WHEN 2 THEN 'OT' END", "area"),
        Cell("FORMACONOCIM",
             "CASE k % 6 WHEN 0 THEN 'R' WHEN 1 THEN 'I' WHEN 2 THEN 'A' WHEN 3 THEN 'P' "
             "WHEN 4 THEN 'Z' END", "form"),
        text("TIPOEVENTODESCRIPCION", "t1"),
        unused("IDUSUARIO"), unused("TIPOEVENTO"), unused("FECHAASCENSO"),
        mostly_null("OBSERVACION", 1, gone=True), mostly_null("DETALLE", 2, gone=False),
        constant("ORIGEN"), empty("VACIA"),
    )),
    "carga_academica_disponible": (LINES, (
        whole("IDPERSONA", 1, holes=False), whole("IDCURSO", 2, holes=False),
        Cell("IDUNIDAD", whole("IDUNIDAD", 3).sql, gone=True),
        stamp("FECHA_INICIO", 2, holes=False),
        Cell("FECHA_FIN", stamp("FECHA_FIN", 3).sql, gone=True),
        Cell("NUMREGISTRADOS", "concat('', v)", "number"),
        text("NOMBREUNIDAD", "t1", holes=False),
    )),
    "carga_politecnica_disponible": (ORDERS, (
        Cell("TERMINO1", "CASE WHEN k % 2 = 0 THEN 'T1' ELSE ' ' END", gone=True),
        Cell("TERMINO2", "CASE WHEN k % 3 = 0 THEN 'T2' END", gone=True),
        Cell("TERMINO3", "CASE WHEN k % 5 = 0 THEN 'T3' ELSE '' END", gone=True),
        whole("IDPERSONA", 1), whole("IDUNIDADCARGA", 2), stamp("FECHA_INICIO", 3),
        flag("APROBADO", 1), Cell("ANIO", "concat('', 2000 + k % 20)"),
        text("NOMBREUNIDAD", "t1"), unused("EMAIL"), unused("EMAILALTERNO"), constant("SISTEMA"),
    )),
    "catalogo_actividades_carga": (PARTS, (
        whole("IDTIPOACTIVIDAD", 1), whole("IDTIPOACTIVIDADCABECERA", 2),
        flag("TIPOCALCULO", 1), flag("TIENELIMITE", 2), text("ACTIVIDAD", "t1"),
        text("DURACIONTIPO", "t2"), unused("ULTIMO_CAMBIO"),
    )),
    "catalogo_idiomas": (PARTS, (
        text("IDIDIOMA", "concat('', k)", holes=False), text("IDIOMA", "t1"), constant("ESTADO"),
    )),
    "certificados_todos": (EVENTS, (
        whole("IDCAPACITACION", 1), whole("IDPERSONA", 2), whole("IDPAIS", 3),
        stamp("FECHAINICIO", 1), stamp("FECHAASCENSO", 2), flag("ENESCALAFON", 1),
        Cell("REVISADOPARAESCALAFON", "CASE WHEN k >= 0 THEN 'S' END", "flag"),
        text("CERTIFICADOPOR", "t2"), mostly_null("NOTA", 2, gone=True),
        mostly_null("ENLACE", 3, gone=False), unused("ULTIMO_CAMBIO"),
    )),
    "datos_personales_ultimos_5anios": (CUSTOMERS, (
        whole("IDPERSONA", 1), stamp("FECHANACIMIENTO", 1),
        Cell("SEXO", "CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M ' END"),
        text("ESTADOCIVIL", "t1"), text("PROVINCIAORIGEN", "t2"), empty("CORREO"),
    )),
    "experiencia_externa": (ORDERS, (
        whole("IDHISTORIALABORAL", 1), whole("IDPERSONA", 2), stamp("FECHADESDE", 1),
        stamp("FECHAHASTA", 2),
        Cell("CATEXPERIENCIA", "CASE k % 5 WHEN 0 THEN 'PC' WHEN 1 THEN 'AD' WHEN 2 THEN 'AC ' "
             "WHEN 3 THEN 'ZZ' END", "category"),
        Cell("ROLACADEMICO", "CASE k % 9 WHEN 0 THEN 'PR' WHEN 1 THEN 'FA' WHEN 2 THEN 'PA' "
             "WHEN 3 THEN 'AY' END", "role"),
        text("PAIS", "t1"), constant("FUENTE"),
    )),
    "heteroevaluacion_disponible": (ORDERS, (
        Cell("IDCURSO", "concat('', k % 40)", "int"), Cell("IDPERSONA", "concat(k % 9, '.0')", "int"),
        Cell("PROMEDIO", "concat('', k % 10)", "number"), Cell("ANIO", "concat('', 2010 + k % 5)"),
        Cell("EVALUADOS", "concat('', k % 5)", "number"),
        Cell("REGISTRADOS", "concat('', 10 * (k % 3))", "number"),
        Cell("ANIO.1", "concat('', 2010 + k % 5)"), text("UNIDAD", "t2"), constant("TERMINO"),
    )),
    "idiomas_personas": (TURNS, (
        whole("IDPERSONA", 1), whole("IDIDIOMA", 2), text("IDIOMA", "t1"),
        Cell("IDPERSONA.1", "concat('other', k)", gone=True),
        Cell("IDIDIOMA.1", "concat('other', k)", gone=True),
        stamp("FECHASUBIDAARCHIVO", 1), flag("LENGUANATIVA", 1), text("NIVELLECTURA", "t2"),
        Cell("NIVELMCER", "CASE WHEN k % 97 = 1 THEN concat('B', k % 2) END", gone=True), unused("ULTIMO_CAMBIO"), unused("REFARCHIVO"),
    )),
    "mencion_honor": (CUSTOMERS, (
        whole("IDMENCIONHONOR", 1), whole("IDPERSONA", 2), stamp("FECHA", 1),
        flag("SITIOWEB", 1), text("INSTITUCION", "t2"), text("TIPO", "t1"),
        unused("ULTIMO_CAMBIO"),
    )),
    "ponentes_todos": (EVENTS, (
        whole("IDCAPACITACION", 1), whole("IDPERSONA", 2), whole("IDCANTON", 3),
        stamp("FECHAINICIO", 1), stamp("FECHAFIN", 2), flag("CONSIDERACOMISANT", 1),
        flag("INGRESORRHH", 2), Cell("REVISADOPARAESCALAFON", "CASE WHEN k >= 0 THEN 'N' END", "flag"),
        number("DURACION", "k % 41"), text("NOMBREPAIS", "t1"), empty("ARCHIVO"),
    )),
    "proyecto_grado": (DOCUMENTS, (
        Cell("IDDIRECTOR", "concat('', k % 30)", "int"), text("TEMA", "t1"),
        Cell("NIVELFORMACION", "CASE k % 3 WHEN 0 THEN 'GRADO' WHEN 1 THEN ' POSGRADO' END"),
        Cell("FECHASUSTENTACION", "concat('2015-0', 1 + k % 6, '-15')", "ts"),
        constant("IES"), empty("OBSERVACION"), empty("URLACTA"),
    )),
    "proyectos_investigacion_disponible": (PARTS, (
        whole("IDPROYECTOINVESTIGACION", 1), whole("IDPERSONA", 2), whole("IDAREAFRASCATI2", 3),
        stamp("FECHAINICIO", 1), stamp("FECHAFIN", 2), flag("ENESCALAFON", 1),
        text("STRTIPO", "t2"), text("STRAREACAMPOAMPLIO", "t1"),
        Cell("ULTIMO_CAMBIO", stamp("ULTIMO_CAMBIO", 3).sql, gone=True),
    )),
    "proyectos_vinculacion_disponible": (CUSTOMERS, (
        whole("IDPERSONA", 1), whole("IDVSPROYECTOCOL", 2), stamp("FECHAINICIO", 1),
        flag("ENESCALAFON", 1), text("NOMBREPROGRAMA", "t1"), text("ROLPROYECTO", "t2"),
    )),
    "publicaciones": (DOCUMENTS, (
        whole("IDPUBLICACIONPERSONA", 1), whole("IDPERSONA", 2),
        Cell("ANIO", "concat('', 2000 + k % 25)", "int"), flag("REVISIONPARES", 1),
        flag("REVISTAINDEXADA", 2), flag("ENESCALAFON", 3), text("TITULO", "t2"),
        text("TIPOPUBLICACION", "t1"), mostly_null("CUARTIL", 4, gone=False),
    )),
    "reporte_titulaciones_educacion": (CUSTOMERS, (
        whole("IdPersona", 1), whole("IdTitulacion", 2), stamp("FechaGraduacion", 1),
        flag("ValidadoThTitulo", 1), flag("ValidadoThRankIes", 2), text("Nivel", "t1"),
        text("Institucion", "t2"), empty("Observaciones"),
    )),
}


def _completed(output: str) -> tuple[Cell, ...]:
    """The cells above, and one for every other column that the source's spec casts,
    drops or charts, so that nothing in a spec is left untried."""
    source, cells = BY_OUTPUT[output], RAW[output][1]
    # Columns the spec derives itself.
    have = {c.name for c in cells} | {"EDAD", "NUM_TERMINOS"}
    holes = source.sparse_from > 0.1
    added: list[Cell] = []

    def add(names, make) -> None:
        for name in names:
            if name not in have:
                have.add(name)
                added.append(make(name, len(added) + 5))

    add(source.drop, lambda name, i: unused(name))
    add(source.timestamps, lambda name, i: stamp(name, i, holes))
    add(source.integers, lambda name, i: whole(name, i, holes))
    add(source.flags, lambda name, i: flag(name, i))
    add(source.numbers, lambda name, i: number(name, f"(k + {i}) % 53"))
    charted = [c.column for c in source.charts if c.value is None and not c.column.endswith("_DESC")]
    add(charted, lambda name, i: text(name, "t1", holes))
    return (*cells, *added)


CELLS = {output: _completed(output) for output in RAW}


def raw_sql(output: str) -> str:
    """The raw extract as SQL, every cell text, read alike by Spark and DuckDB."""
    base, cells = RAW[output][0], CELLS[output]
    quote = '"{}"'
    listed = ", ".join(f"{c.sql} AS {quote.format(c.name)}" for c in cells)
    return f"SELECT {listed} FROM ({base}) base"


def raw_extract(spark: SparkSession, sf_dir: str, output: str) -> DataFrame:
    """The raw extract as the CSV reader would deliver it: null spellings are null."""
    base, cells = RAW[output][0], CELLS[output]
    name = base.rsplit(" ", 1)[1]
    rows = spark.sql(base.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))
    return apply_steps(
        spread(rows).select(*(F.expr(c.sql).alias(c.name) for c in cells)),
        [c.name for c in cells],
        null_if_token,
    )
