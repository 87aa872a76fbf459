"""The eighteen staff sources, as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from staffline.functions import (
    active_terms,
    age_in_years,
    column,
    elapsed_years,
    ratio,
    term_flags,
)
from staffline.operators import stats
from staffline.operators.columns import drop_columns
from staffline.operators.decode import (
    TRAINING_AREA,
    TRAINING_FORM,
    describe_contracts,
    describe_experience,
    lookup,
    lookup_or_keep,
    require_mapped,
)
from staffline.operators.periods import require_columns

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Chart:
    """The numbers behind an exploratory chart. ``kind`` is one of year, top,
    counts, histogram and per_key (a histogram of rows per key)."""

    kind: str
    column: str
    top: int = 15
    bins: int = 30
    clip: float | None = 0.99
    value: Callable[[], Column] | None = None

    def data(self, df: DataFrame) -> DataFrame:
        if self.value is None:
            require_columns(df, [self.column])
        if self.kind == "year":
            return stats.rows_per_year(df, self.column)
        if self.kind == "top":
            return stats.top_values(df, self.column, self.top)
        if self.kind == "counts":
            return stats.value_counts(df, self.column, by_value=True)
        if self.kind == "per_key":
            df, value = stats.rows_per_key(df, self.column), F.col("n")
        else:
            value = self.value() if self.value else column(self.column)
        return stats.histogram(df, value, self.bins, self.clip)


def year(name: str) -> Chart:
    return Chart("year", name)


def top(name: str, k: int = 15) -> Chart:
    return Chart("top", name, top=k)


def counts(name: str) -> Chart:
    return Chart("counts", name)


@dataclass(frozen=True)
class Source:
    """One raw extract and the choices that turn it into a processed table. Steps
    run in the order of the fields."""

    file: str
    output: str
    prepare: Step | None = None
    rename: tuple[tuple[str, str], ...] = ()
    collapse: bool = False
    fill: tuple[str, ...] = ()
    sparse_from: float = 0.99
    keep: tuple[str, ...] = ()
    dedupe: bool = False
    drop: tuple[str, ...] = ()
    decode: Step | None = None
    timestamps: tuple[str, ...] = ()
    integers: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    derive: Step | None = None
    charts: tuple[Chart, ...] = ()


def with_terms(df: DataFrame) -> DataFrame:
    """Replace the three term columns by indicators, their sum and a readable list."""
    terms = ["TERMINO1", "TERMINO2", "TERMINO3"]
    require_columns(df, terms)
    flags = [f"APLICA_T{i}" for i in (1, 2, 3)]
    df = df.withColumns(dict(zip(flags, term_flags([F.col(t) for t in terms]))))
    df = df.withColumn("NUM_TERMINOS", sum((F.col(f) for f in flags[1:]), F.col(flags[0])))
    df = df.withColumn("TERMINOS_ACTIVOS", active_terms([F.col(f) for f in flags]))
    return drop_columns(df, terms)


def describe_trainings(df: DataFrame) -> DataFrame:
    """Describe a training's area, whose codes must all be known, and its form."""
    area, form = "AREACAPACITACIONDESCRIPCION", "FORMACONOCIM"
    require_columns(df, [area, form])
    require_mapped(df, area, TRAINING_AREA)
    return df.withColumns({
        area: lookup(F.col(area), TRAINING_AREA),
        form: lookup_or_keep(F.col(form), TRAINING_FORM),
    })


# Fixed value: the day ages are computed for.
AGE_DAY = "2026-08-31"


def with_age(df: DataFrame) -> DataFrame:
    require_columns(df, ["FECHANACIMIENTO"])
    return df.withColumn("EDAD", age_in_years(F.col("FECHANACIMIENTO"), AGE_DAY))


def experience_years() -> Column:
    return elapsed_years(F.col("FECHADESDE"), F.col("FECHAHASTA"))


def participation() -> Column:
    return ratio(F.col("EVALUADOS"), F.col("REGISTRADOS"))


# File, column and output names, thresholds and chart sizes of the
# sources.
SOURCES = (
    Source(
        "capacitacionestodas", "capacitaciones_todas",
        sparse_from=0.86,
        keep=("FORMACONOCIM",),
        drop=(
            "GESTIONUATHESPOL", "ORIGENINGRESO", "INGRESORRHH", "IDUSUARIO",
            "CONSIDERACOMISANT", "ENESCALAFON", "REVISADOPARAESCALAFON", "IDPAIS",
            "TIPOCERTIFICADO", "TIPOCAPACITACION", "IDINSTITUCION", "TIPOEVENTO",
            "NAMEARCHDOC", "IDTIPOCONOCIMIEN", "TIPOMODALIDAD", "ULTIMO_CAMBIO",
            "FECHAASCENSO",
        ),
        decode=describe_trainings,
        timestamps=(
            "FECHAINICIO", "FECHAFIN", "FECHACHECKESCALAFON", "FECHASUBIDAARCHIVO",
            "FECHAAPROBACION",
        ),
        integers=("IDCAPACITACION", "IDPERSONA", "IDCIUDAD", "IDCANTON"),
        charts=(
            year("FECHAINICIO"), top("TIPOEVENTODESCRIPCION", 10),
            Chart("per_key", "IDPERSONA"),
        ),
    ),
    Source(
        "cargaacademicadisponible", "carga_academica_disponible",
        sparse_from=0.001,
        timestamps=("FECHAAPROBPLANIF", "FECHAINICIOREGIST", "FECHA_INICIO", "FECHA_FIN"),
        integers=(
            "IDPERSONA", "IDCURSO", "IDUNIDAD", "IDMATERIA", "IDTIPOACTIVIDAD",
            "IDPERIODO", "IDCPLCAMBIOSCURSO",
        ),
        numbers=("NUMREGISTRADOS",),
        charts=(Chart("histogram", "NUMREGISTRADOS"), top("NOMBREUNIDAD", 10)),
    ),
    Source(
        "cargapolitecnicadisponible", "carga_politecnica_disponible",
        prepare=with_terms,
        keep=("TERMINON1", "TERMINON2", "TERMINON3"),
        drop=("EMAILALTERNO", "EMAIL"),
        timestamps=("FECHAAPROBPLANIF", "FECHAINICIOREGIST", "FECHA_INICIO", "FECHA_FIN"),
        integers=(
            "IDPERSONA", "IDCURSO", "IDUNIDAD", "IDUNIDADCARGA", "IDMATERIA",
            "IDTIPOACTIVIDAD", "IDPERIODO", "IDCPLCAMBIOSCURSO",
        ),
        flags=("APROBADO",),
        charts=(counts("ANIO"), top("NOMBREUNIDAD", 10), counts("NUM_TERMINOS")),
    ),
    Source(
        "catalogoactividadescarga", "catalogo_actividades_carga",
        drop=("ULTIMO_CAMBIO",),
        integers=("IDTIPOACTIVIDAD", "IDTIPOACTIVIDADCABECERA"),
        flags=("TIPOCALCULO", "TIENELIMITE"),
        charts=(top("ACTIVIDAD", 10), top("DURACIONTIPO", 19)),
    ),
    Source("catalogoidiomas", "catalogo_idiomas"),
    Source(
        "certificadostodos", "certificados_todos",
        sparse_from=0.78,
        keep=("REVISADOPARAESCALAFON",),
        drop=("ULTIMO_CAMBIO",),
        timestamps=(
            "FECHAINICIO", "FECHAFIN", "FECHAASCENSO", "FECHACHECKESCALAFON",
            "FECHASUBIDAARCHIVO", "FECHAAPROBACION",
        ),
        integers=(
            "IDCAPACITACION", "IDPERSONA", "IDPAIS", "IDCIUDAD", "IDINSTITUCION",
            "IDUSUARIO", "IDCANTON", "IDTIPOCONOCIMIEN",
        ),
        flags=("REVISADOPARAESCALAFON", "ENESCALAFON", "INGRESORRHH", "GESTIONUATHESPOL"),
        charts=(year("FECHAINICIO"), top("CERTIFICADOPOR", 10), top("TIPOMODALIDADDESCRIPCION")),
    ),
    Source(
        "datos_personales_ultimos_5anios", "datos_personales_ultimos_5anios",
        timestamps=("FECHANACIMIENTO",),
        integers=("IDPERSONA",),
        derive=with_age,
        charts=(
            Chart("histogram", "EDAD", bins=25, clip=None), top("SEXO"), top("ESTADOCIVIL"),
            top("PROVINCIAORIGEN", 10),
        ),
    ),
    Source(
        "experenciaexterna", "experiencia_externa",
        timestamps=("FECHADESDE", "FECHAHASTA"),
        integers=("IDHISTORIALABORAL", "IDPERSONA", "IDPAIS"),
        derive=describe_experience,
        charts=(
            top("CATEXPERIENCIA_DESC"), top("ROLACADEMICO_DESC"),
            Chart("histogram", "DURACION_ANIOS", value=experience_years), top("PAIS", 10),
        ),
    ),
    Source(
        "heteroevaluaciondisponible", "heteroevaluacion_disponible",
        dedupe=True,
        integers=("IDCURSO", "IDPERSONA"),
        numbers=("PROMEDIO", "EVALUADOS", "REGISTRADOS"),
        charts=(
            Chart("histogram", "PROMEDIO", clip=None), counts("ANIO"), top("UNIDAD", 10),
            Chart("histogram", "TASA_PARTICIPACION", clip=None, value=participation),
        ),
    ),
    Source(
        "historialaboralpersonas", "historial_laboral_personas",
        rename=(("NOMBRE", "NOMBRE_UNIDAD"),),
        fill=("NOMBRE_UNIDAD",),
        keep=(
            "IDPERSONA", "IDCONTRATOLABORAL", "NOMBRETABLA", "IDUBICACIONFISICAEMP",
            "TIPOEMPLEADO", "NOMBRE_UNIDAD", "IDESTRUCTURAORGANICA",
        ),
        timestamps=(
            "FECHAINICIOCONTRATO", "FECHAFINCONTRATO", "FECHAVIGENCIA",
            "FECHADESVINCULACION", "FECHAINGRESOESPOL", "FECHAREGISTRO",
        ),
        integers=(
            "IDPERSONA", "IDCONTRATOLABORAL", "IDCARGO", "IDUNIDAD",
            "IDUBICACIONFISICAEMP", "IDUSUARIO", "IDUNIDADACADEMICAFIS",
            "IDESTRUCTURAORGANICA",
        ),
        numbers=("RMU",),
        derive=describe_contracts,
    ),
    Source(
        "idiomaspersonas", "idiomas_personas",
        collapse=True,
        sparse_from=0.90,
        drop=("ULTIMO_CAMBIO", "REFARCHIVO"),
        timestamps=("ULTIMO_CAMBIO", "FECHASUBIDAARCHIVO"),
        integers=("IDPERSONA", "IDIDIOMA", "IDIDIOMAPERSONA"),
        flags=("LENGUANATIVA",),
        charts=(
            top("IDIOMA", 12), top("NIVELMCER", 6), top("NIVELLECTURA"), counts("LENGUANATIVA"),
        ),
    ),
    Source(
        "mencionhonor", "mencion_honor",
        sparse_from=0.98,
        drop=("ULTIMO_CAMBIO",),
        timestamps=("ULTIMO_CAMBIO", "FECHA"),
        integers=("IDMENCIONHONOR", "IDINSTITUCION", "IDPAIS", "IDPERSONA"),
        flags=("SITIOWEB",),
        charts=(year("FECHA"), top("INSTITUCION", 10), top("TIPO")),
    ),
    Source(
        "ponentestodos", "ponentes_todos",
        sparse_from=0.987,
        keep=("REVISADOPARAESCALAFON",),
        drop=("ULTIMO_CAMBIO",),
        timestamps=(
            "FECHAINICIO", "FECHAFIN", "FECHAASCENSO", "FECHACHECKESCALAFON",
            "FECHASUBIDAARCHIVO", "FECHAAPROBACION",
        ),
        integers=(
            "IDCAPACITACION", "IDPERSONA", "IDPAIS", "IDCIUDAD", "IDINSTITUCION",
            "IDUSUARIO", "IDCANTON", "IDTIPOCONOCIMIEN",
        ),
        flags=(
            "ENESCALAFON", "CONSIDERACOMISANT", "INGRESORRHH", "REVISADOPARAESCALAFON",
            "GESTIONUATHESPOL",
        ),
        numbers=("DURACION",),
        charts=(
            year("FECHAINICIO"), top("NOMBREPAIS", 10), top("TIPOMODALIDADDESCRIPCION"),
            Chart("histogram", "DURACION"),
        ),
    ),
    Source(
        "proyecto_grado", "proyecto_grado",
        dedupe=True,
        drop=("URLACTA",),
        timestamps=("FECHASUSTENTACION",),
        integers=("IDDIRECTOR",),
        charts=(year("FECHASUSTENTACION"), top("NOMBREPROGRAMA", 10), top("NIVELFORMACION")),
    ),
    Source(
        "proyectosinvestigaciondisponible", "proyectos_investigacion_disponible",
        drop=("ULTIMO_CAMBIO",),
        timestamps=("FECHAINICIO", "FECHAFIN", "ULTIMO_CAMBIO"),
        integers=(
            "IDPROYECTOINVESTIGACION", "IDPERSONA", "IDPAIS", "IDROLPROYECTO",
            "IDNOMENCLATURATIT", "IDNOMENCLATURATIT2", "IDAREACONOCIM", "IDSUBAREACONOC",
            "IDAREACONOCIM2", "IDSUBAREACONOC2", "IDAREAFRASCATI", "IDSUBAREAFRASCATI",
            "IDAREAFRASCATI2", "IDSUBAREAFRASCATI2",
        ),
        flags=("ENESCALAFON",),
        charts=(
            year("FECHAINICIO"), top("STRTIPO"), top("STRAREACAMPOAMPLIO", 10),
            top("INSTITUCION_EXTERNA", 10),
        ),
    ),
    Source(
        "proyectosvinculaciondisponible", "proyectos_vinculacion_disponible",
        timestamps=("FECHAINICIO", "FECHAFIN"),
        integers=("IDPERSONA", "IDPROYECTOINVESTIGACION", "IDAREACONOCIM", "IDVSPROYECTOCOL"),
        flags=("ENESCALAFON",),
        charts=(year("FECHAINICIO"), top("NOMBREPROGRAMA", 10), top("ROLPROYECTO")),
    ),
    Source(
        "publicaciones", "publicaciones",
        integers=("IDPUBLICACIONPERSONA", "IDPERSONA", "ANIO"),
        flags=("REVISIONPARES", "REVISTAINDEXADA", "ENESCALAFON"),
        charts=(counts("ANIO"), top("TIPOPUBLICACION", 10), top("CUARTIL")),
    ),
    Source(
        "ReporteTitulacionesEducacion", "reporte_titulaciones_educacion",
        timestamps=("FechaGraduacion", "FechaSubidaArchivoTitulo"),
        integers=("IdPersona", "IdTitulacion", "IdNomenclaturaTit", "IdPrograma"),
        flags=(
            "ValidadoThTitulo", "ValidadoThMateriasAprobadas", "ValidadoThRankGraduado",
            "ValidadoThRankIes",
        ),
        charts=(year("FechaGraduacion"), top("Nivel"), top("Institucion", 10), top("Pais", 10)),
    ),
)

BY_OUTPUT = {source.output: source for source in SOURCES}

# Columns of the work history left out of its processed table.
HISTORY_UNUSED = (
    "IDCARGO", "IDUNIDAD", "MODULO", "HORARIOFLEXIBLE", "FECHAVIGENCIA", "HORAS",
    "FECHAINGRESOESPOL", "ESPORCONCURSO", "REFARCHIVO1", "REFARCHIVO2", "FECHAREGISTRO",
    "IDUSUARIO", "TIPOVINCULO", "IDUNIDADACADEMICAFIS",
)
HISTORY_OUTPUT = "historial_laboral_personas"
PERIODS_OUTPUT = "historial_laboral_periodos_continuos"
FEATURES_OUTPUT = "historial_laboral_features"
