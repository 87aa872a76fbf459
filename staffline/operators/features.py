"""One feature row per person from contracts and continuous periods."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from staffline.functions import days_between, ntz, ratio, round_half_even
from staffline.functions.calendar import DAYS_PER_YEAR
from staffline.operators.changes import PAY, POST, flag_changes, flag_pay_steps
from staffline.operators.history import (
    HOT_ROWS,
    OrderedHistory,
    ordered_histories,
    union_all,
)
from staffline.operators.periods import (
    PERSON,
    START,
    end_of_contract,
    require_columns,
    tie_break,
)

UNIT_ID = "IDESTRUCTURAORGANICA"
UNIT = "NOMBRE_UNIDAD"
REGIME = "IDREGIMENLABORAL_DESC"
ROLE = "TIPOEMPLEADO_DESC"
DEDICATION = "TIPODEDICACION"
STATE = "ESTADOCONTRATO"
MOVE = "TIPO"

# Labels the features test for.
TEACHER = "DOCENTE"
ROLES = (TEACHER, "ADMINISTRATIVO")
FINISHED = "FF"
ENTRY_MOVE = "V"
FACULTY_TEXT = "FACULTAD"
RECTORATE_TEXT = "RECTORADO"

_SOURCE_COLUMNS = (POST, PAY, UNIT_ID, UNIT, REGIME, ROLE, DEDICATION, STATE, MOVE)
_YEAR = "_year"


def years(days: Column) -> Column:
    """Days as decimal years with two digits."""
    return round_half_even(days / F.lit(DAYS_PER_YEAR), 2)


def _mentions(name: Column, text: str) -> Column:
    return F.coalesce(F.contains(F.upper(name), F.lit(text)), F.lit(False))


def _distinct_inputs(have: set[str]) -> dict[str, tuple[Column, str, str | None]]:
    """Values whose distinct count (and most frequent value) becomes a feature:
    kind -> (value, distinct feature, mode feature)."""
    inputs: dict[str, tuple[Column, str, str | None]] = {}
    if POST in have:
        inputs["post"] = (F.col(POST), "N_CARGOS_DISTINTOS", "CARGO_MAS_FRECUENTE")
    if UNIT_ID in have:
        inputs["unit"] = (F.col(UNIT_ID), "N_UNIDADES_DISTINTAS", None)
    if UNIT in have:
        faculty = F.when(_mentions(F.col(UNIT), FACULTY_TEXT), F.col(UNIT))
        inputs["faculty"] = (faculty, "N_FACULTADES_DISTINTAS", None)
    if REGIME in have:
        inputs["regime"] = (F.col(REGIME), "N_REGIMENES_DISTINTOS", None)
    if {ROLE, DEDICATION} <= have:
        teaching = F.when(F.col(ROLE) == TEACHER, F.col(DEDICATION))
        inputs["dedication"] = (
            teaching,
            "N_DEDICACIONES_DOCENTE_DISTINTAS",
            "DEDICACION_DOCENTE_MAS_FRECUENTE",
        )
    return inputs


def _ordered_aggregates(history: OrderedHistory, have: set[str], with_pay: bool) -> list[Column]:
    """Aggregates that keep a small state per person however many rows there are."""
    at = history.position()

    def first(c: Column) -> Column:
        return F.min_by(c, at)

    def last(c: Column) -> Column:
        return F.max_by(c, at)

    out = [
        F.count("*").alias("N_REGISTROS_HISTORIAL"),
        F.count_if("_changed").alias("N_CONTRATOS_TOTAL"),
    ]
    if POST in have:
        out.append(last(F.col(POST)).alias("CARGO_ACTUAL"))
    if UNIT in have:
        out += [
            last(F.col(UNIT)).alias("UNIDAD_ACTUAL_NOMBRE"),
            F.bool_or(_mentions(F.col(UNIT), RECTORATE_TEXT)).alias("PASO_POR_RECTORADO"),
        ]
    if REGIME in have:
        out += [
            first(F.col(REGIME)).alias("REGIMEN_INICIAL_DESC"),
            last(F.col(REGIME)).alias("REGIMEN_ACTUAL_DESC"),
        ]
    if ROLE in have:
        mixed = F.min(ROLE) != F.max(ROLE)
        out += [
            last(F.col(ROLE)).alias("TIPOEMPLEADO_ACTUAL_DESC"),
            F.coalesce(mixed, F.lit(False)).alias("ES_DOCENTE_ADMIN_MIXTO"),
        ]
        for role in ROLES:
            days = F.coalesce(F.sum(F.when(F.col(ROLE) == role, F.col("_days"))), F.lit(0))
            out.append(years(days).alias(f"ANIOS_EXPERIENCIA_{role}"))
    if {ROLE, DEDICATION} <= have:
        teaching = F.when(F.col(ROLE) == TEACHER, F.col(DEDICATION))
        known_at = F.when(teaching.isNotNull(), at)
        out.append(F.max_by(teaching, known_at).alias("DEDICACION_DOCENTE_ACTUAL"))
    if with_pay:
        pay = F.col(PAY)
        paid_at = F.when(pay.isNotNull(), at)
        initial, current = F.min_by(pay, paid_at), F.max_by(pay, paid_at)
        growth = round_half_even(F.try_divide(current - initial, initial) * 100, 2)
        steps = F.when(F.count(pay) > 0, F.count_if("_pay_step"))
        out += [
            initial.alias("RMU_INICIAL"),
            current.alias("RMU_ACTUAL"),
            F.min(pay).alias("RMU_MIN"),
            F.max(pay).alias("RMU_MAX"),
            round_half_even(F.avg(pay), 2).alias("RMU_PROMEDIO"),
            (current - initial).alias("RMU_CRECIMIENTO_ABS"),
            growth.alias("RMU_CRECIMIENTO_PCT"),
            steps.alias("N_CAMBIOS_RMU"),
        ]
    if STATE in have:
        counted = F.col(STATE).isNotNull()
        if MOVE in have:
            counted &= F.col(MOVE) == ENTRY_MOVE
        finished = F.when(counted, (F.col(STATE) == FINISHED).cast("double"))
        share = round_half_even(F.avg(finished), 2)
        out.append(share.alias("PROPORCION_CONTRATOS_FINALIZADOS"))
    return out


def _within_task(history: OrderedHistory, have: set[str], ordered: list[Column]) -> DataFrame:
    """Persons of at most ``hot_rows`` rows: one exchange, sets held per person."""
    out = list(ordered)
    for value, distinct, mode in _distinct_inputs(have).values():
        out.append(F.size(F.collect_set(value)).cast("bigint").alias(distinct))
        if mode:
            out.append(F.mode(value, deterministic=True).alias(mode))
    rows = history.rows
    if POST in have:
        # More than one post in a year: the pairs outnumber the years they fall in.
        posts = F.collect_set(F.when(F.col(POST).isNotNull(), F.struct(_YEAR, POST)))
        spans = F.collect_set(F.when(F.col(POST).isNotNull(), F.col(_YEAR)))
        out.append((F.size(posts) > F.size(spans)).alias("MULTIPLES_CARGOS_MISMO_ANIO"))
    return rows.groupBy(PERSON).agg(*out)


def _across_tasks(history: OrderedHistory, have: set[str], ordered: list[Column]) -> DataFrame:
    """Hot persons: distinct values are counted in two levels, so that no task holds
    a person's whole value set; all else aggregates partially in every chunk."""
    features = history.rows.groupBy(PERSON).agg(*ordered)
    inputs = _distinct_inputs(have)
    if not inputs:
        return features

    nothing = F.lit(None).cast("string")
    entries = [
        F.struct(
            F.lit(kind).alias("kind"),
            value.cast("string").alias("value"),
            nothing.alias("post"),
        )
        for kind, (value, _, _) in inputs.items()
    ]
    if POST in have:
        entries.append(
            F.struct(
                F.lit("year").alias("kind"),
                F.col(_YEAR).cast("string").alias("value"),
                F.col(POST).alias("post"),
            )
        )
    values = (
        history.rows.select(PERSON, F.explode(F.array(*entries)).alias("e"))
        .where("e.value IS NOT NULL")
        .groupBy(PERSON, "e.kind", "e.value")
        .agg(
            F.count("*").alias("n"),
            (F.min("e.post") != F.max("e.post")).alias("several"),
        )
    )
    out = []
    for kind, (_, distinct, mode) in inputs.items():
        of_kind = F.col("kind") == kind
        out.append(F.count_if(of_kind).alias(distinct))
        if mode:
            rank = F.when(of_kind, F.struct(-F.col("n"), F.col("value")))
            out.append(F.min_by("value", rank).alias(mode))
    if POST in have:
        several = F.bool_or((F.col("kind") == "year") & F.coalesce("several", F.lit(False)))
        out.append(several.alias("MULTIPLES_CARGOS_MISMO_ANIO"))
    # A person without any such value has no row on the right.
    none = {distinct: 0 for _, distinct, _ in inputs.values()}
    if POST in have:
        none["MULTIPLES_CARGOS_MISMO_ANIO"] = False
    return features.join(values.groupBy(PERSON).agg(*out), PERSON, "left").na.fill(none)


def feature_columns(have: Iterable[str], with_pay: bool) -> list[str]:
    """Contract features in order, for the source columns at hand."""
    have = set(have)
    names = ["N_REGISTROS_HISTORIAL", "N_CONTRATOS_TOTAL"]
    if POST in have:
        names += [
            "N_CARGOS_DISTINTOS", "CARGO_ACTUAL", "CARGO_MAS_FRECUENTE",
            "MULTIPLES_CARGOS_MISMO_ANIO",
        ]
    if UNIT_ID in have:
        names += ["N_UNIDADES_DISTINTAS"]
    if UNIT in have:
        names += ["UNIDAD_ACTUAL_NOMBRE", "N_FACULTADES_DISTINTAS", "PASO_POR_RECTORADO"]
    if REGIME in have:
        names += ["N_REGIMENES_DISTINTOS", "REGIMEN_INICIAL_DESC", "REGIMEN_ACTUAL_DESC"]
    if ROLE in have:
        names += ["TIPOEMPLEADO_ACTUAL_DESC", "ES_DOCENTE_ADMIN_MIXTO"]
        names += [f"ANIOS_EXPERIENCIA_{role}" for role in ROLES]
        if DEDICATION in have:
            names += [
                "DEDICACION_DOCENTE_ACTUAL", "DEDICACION_DOCENTE_MAS_FRECUENTE",
                "N_DEDICACIONES_DOCENTE_DISTINTAS",
            ]
    if with_pay and PAY in have:
        names += [
            "RMU_INICIAL", "RMU_ACTUAL", "RMU_MIN", "RMU_MAX", "RMU_PROMEDIO",
            "RMU_CRECIMIENTO_ABS", "RMU_CRECIMIENTO_PCT", "N_CAMBIOS_RMU",
        ]
    if STATE in have:
        names += ["PROPORCION_CONTRATOS_FINALIZADOS"]
    return names


def contract_features(
    df: DataFrame,
    as_of: str | date,
    with_pay: bool = False,
    null_safe_changes: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Features of each person's contracts. Only the source columns that exist in
    ``df`` contribute. Pay features are off by default: histories may mix currencies."""
    require_columns(df, [PERSON, START])
    have = {c for c in _SOURCE_COLUMNS if c in df.columns}
    with_pay = with_pay and PAY in have
    start, end = ntz(F.col(START)), end_of_contract(df)
    contracts = df.where(F.col(PERSON).isNotNull() & F.col(START).isNotNull()).select(
        PERSON,
        start.alias("_start"),
        *(F.col(t).alias("_order") for t in tie_break(df)),
        (days_between(start, F.coalesce(end, ntz(as_of))) + 1).alias("_days"),
        F.year(start).alias(_YEAR),
        *(F.col(c) for c in _SOURCE_COLUMNS if c in have),
    )
    results = []
    for part in ordered_histories(contracts, PERSON, ["_start", "_order"], hot_rows):
        part = flag_changes(part, "_changed", null_safe_changes)
        if with_pay:
            part = flag_pay_steps(part, "_pay_step")
        ordered = _ordered_aggregates(part, have, with_pay)
        build = _within_task if part.chunk is None else _across_tasks
        results.append(build(part, have, ordered).select(PERSON, *feature_columns(have, with_pay)))
    return union_all(results)


def change_counts(df: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """How many of each person's contracts count as changes, by the usual rule and by the
    null-safe one, from one history."""
    require_columns(df, [PERSON, START])
    contracts = df.where(F.col(PERSON).isNotNull() & F.col(START).isNotNull()).select(
        PERSON,
        ntz(F.col(START)).alias("_start"),
        *(F.col(t).alias("_order") for t in tie_break(df)),
        *(F.col(c) for c in (POST, PAY) if c in df.columns),
    )
    results = []
    for part in ordered_histories(contracts, PERSON, ["_start", "_order"], hot_rows):
        part = flag_changes(part, "_usual")
        part = flag_changes(part, "_null_safe", null_safe=True)
        results.append(part.rows.groupBy(PERSON).agg(
            F.count_if("_usual").alias("changes"),
            F.count_if("_null_safe").alias("changes_null_safe"),
        ))
    return union_all(results)


def tenure_features(periods: DataFrame, as_of: str | date) -> DataFrame:
    """Tenure of each person, from continuous periods."""
    summary = periods.groupBy(PERSON).agg(
        F.min("PERIODO_INICIO").alias("FECHA_PRIMER_INGRESO"),
        F.max(F.coalesce("PERIODO_FIN", ntz(as_of))).alias("FECHA_ULTIMO_PERIODO_FIN"),
        F.count("*").alias("N_PERIODOS_CONTINUOS"),
        F.sum("PERIODO_DURACION_DIAS").alias("ANTIGUEDAD_EFECTIVA_DIAS"),
        F.bool_or("PERIODO_VIGENTE").alias("VIGENTE_ACTUALMENTE"),
    )
    calendar = days_between(F.col("FECHA_PRIMER_INGRESO"), F.col("FECHA_ULTIMO_PERIODO_FIN")) + 1
    return (
        summary.withColumn("ANTIGUEDAD_EFECTIVA_ANIOS", years(F.col("ANTIGUEDAD_EFECTIVA_DIAS")))
        .withColumn("ANTIGUEDAD_CALENDARIO_DIAS", calendar.cast("bigint"))
        .withColumn("ANTIGUEDAD_CALENDARIO_ANIOS", years(F.col("ANTIGUEDAD_CALENDARIO_DIAS")))
        .withColumn("N_REINGRESOS", F.col("N_PERIODOS_CONTINUOS") - 1)
    )


def person_features(
    df: DataFrame,
    periods: DataFrame | None,
    as_of: str | date,
    with_pay: bool = False,
    null_safe_changes: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Contract features, with tenure joined on when periods are given."""
    features = contract_features(df, as_of, with_pay, null_safe_changes, hot_rows)
    if periods is None:
        return features
    return features.join(tenure_features(periods, as_of), PERSON, "left")
