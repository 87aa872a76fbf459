"""Codes to descriptions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from staffline.functions import column
from staffline.operators.columns import cast_integers

# Code dictionaries of the sources.
EXPERIENCE_CATEGORY = {
    "PC": "POR CLASIFICAR",
    "AD": "ADMINISTRATIVA",
    "AC": "ACADEMICA",
}
ACADEMIC_ROLE = {
    "PR": "PROFESOR",
    "FA": "FACILITADOR",
    "PA": "PERSONAL DE APOYO",
    "AY": "AYUDANTE",
}
EMPLOYEE_TYPE = {
    "AA": "ADMINISTRATIVO",
    "DD": "DOCENTE",
}
LABOUR_REGIME = {
    0: "CONTRATO CIVIL",
    7: "LOSEP - LEY ORGANICA DE SERVICIO PUBLICO",
    8: "LOES - LEY ORGANICA DE EDUCACION SUPERIOR",
    9: "CT - CODIGO DE TRABAJO",
}
TRAINING_AREA = {"DI": "Disciplinar", "PE": "Pedagógica", "OT": "Otra"}
TRAINING_FORM = {
    "R": "PARTICIPANTES-RECIBIDOS",
    "I": "INSTRUCTOR-IMPARTIDOS",
    "A": "ASISTENCIA",
    "P": "PRESENTACION",
}
TRAINING_MODE = {"P": "PRESENCIAL", "L": "VIRTUAL"}


def lookup(code: Column, dictionary: Mapping) -> Column:
    """Description of a code; null when the code is unknown."""
    pairs = [F.lit(x) for pair in dictionary.items() for x in pair]
    return F.create_map(*pairs)[code] if pairs else F.lit(None).cast("string")


def lookup_or_keep(code: Column, dictionary: Mapping) -> Column:
    """Description of a code; the code itself when unknown."""
    return F.coalesce(lookup(code, dictionary), code)


def lookup_or_blank(code: Column, dictionary: Mapping) -> Column:
    """Description of a code; an empty text when unknown."""
    return F.coalesce(lookup(code, dictionary), F.lit(""))


def describe_experience(df: DataFrame) -> DataFrame:
    """Describe the codes of external experience, for the columns that exist."""
    if "CATEXPERIENCIA" in df.columns:
        described = lookup(F.col("CATEXPERIENCIA"), EXPERIENCE_CATEGORY)
        df = df.withColumn("CATEXPERIENCIA_DESC", described)
    if "ROLACADEMICO" in df.columns:
        df = df.withColumn("ROLACADEMICO_DESC", lookup(F.col("ROLACADEMICO"), ACADEMIC_ROLE))
    return df


def describe_contracts(df: DataFrame) -> DataFrame:
    """Describe the codes of the work history, for the columns that exist."""
    if "TIPOEMPLEADO" in df.columns:
        df = df.withColumn("TIPOEMPLEADO_DESC", lookup(F.col("TIPOEMPLEADO"), EMPLOYEE_TYPE))
    if "IDREGIMENLABORAL" in df.columns:
        code = "IDREGIMENLABORAL_DESC"
        df = df.withColumn(code, F.col("IDREGIMENLABORAL"))
        df = cast_integers(df, [code], on_fraction="null")
        df = df.withColumn(code, lookup(F.col(code).cast("int"), LABOUR_REGIME))
    return df


def override(key: Column, corrections: Mapping, value: Column) -> Column:
    """Hand-made corrections by key over the existing value."""
    return F.coalesce(lookup(key, corrections), value) if corrections else value


def require_unique(table: DataFrame, key: str) -> None:
    """A repeated key would multiply the rows it is joined to."""
    repeated = table.where(column(key).isNotNull()).groupBy(key).count().where("count > 1")
    if found := [r[0] for r in repeated.select(key).limit(5).collect()]:
        raise ValueError(f"{key} is not unique, for example {found}")


def override_from(df: DataFrame, corrections: DataFrame, key: str, value: str) -> DataFrame:
    """As ``override``, with the corrections in a table of (key, value)."""
    require_unique(corrections, key)
    fixed = corrections.select(key, F.col(value).alias("_fixed"))
    joined = df.join(fixed, key, "left")
    return joined.withColumn(value, F.coalesce("_fixed", column(value))).select(*df.columns)


def unmapped_codes(df: DataFrame, name: str, known: Mapping | DataFrame) -> DataFrame:
    """Distinct non-null codes missing from a dictionary, or from a catalogue table
    whose code column has the same name."""
    codes = df.select(name).where(F.col(name).isNotNull())
    if isinstance(known, DataFrame):
        return codes.join(known.select(name).distinct(), name, "left_anti").distinct()
    return codes.where(~F.col(name).isin(*known)).distinct()


def require_mapped(df: DataFrame, name: str, known: Mapping | DataFrame) -> None:
    stray = sorted(r[0] for r in unmapped_codes(df, name, known).collect())
    if stray:
        raise AssertionError(f"codes without a description in {name}: {stray}")


def decode_from(df: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Left-join a catalogue's descriptions. Spark measures the catalogue and
    broadcasts it if small; a large one is joined by key, hot keys split."""
    require_unique(catalogue, key)
    return df.join(catalogue, key, "left")


def not_in(df: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Rows that break a subset relation: their key is absent from ``whole``."""
    return df.join(whole.select(key).distinct(), key, "left_anti")
