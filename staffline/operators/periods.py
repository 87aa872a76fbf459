"""Continuous employment periods.

Contracts of a person, in start order, join the current period while its end F
reaches their start (F then grows to the later end), or while the gap is only
administrative (F then becomes the contract's own end, even an earlier one). Any
other gap opens a new period. A null end is open and later than everything.

The rule reads like a loop, but F is a running maximum in disguise. Call a contract
*proper* when it does not end before it starts. F reaches a start s exactly when an
earlier proper contract ends at or after s: such an end stays in F until s, and an
improper end lies before its own start, hence before s. So "F does not reach s"
(a break) needs only a running maximum over proper ends. At each break F is set to
the contract's end, and from there on it only grows; F before a contract is thus
the largest end since the last break. Two running maxima and two running sums give
the periods, without any per-person loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from staffline.functions import days_between, effective_end, month_cut_continues, ntz
from staffline.operators.history import (
    HOT_ROWS,
    ORDINAL,
    OrderedHistory,
    ordered_histories,
    union_all,
)

PERSON = "IDPERSONA"
CONTRACT = "IDCONTRATOLABORAL"
START = "FECHAINICIOCONTRATO"
PLANNED_END = "FECHAFINCONTRATO"
DISMISSAL = "FECHADESVINCULACION"

# Stands for an open end while comparing; beyond every date the parser lets through.
_OPEN = "9999-12-31"


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")


def end_of_contract(df: DataFrame) -> Column:
    def moment(name: str) -> Column | None:
        return ntz(F.col(name)) if name in df.columns else None

    return effective_end(moment(DISMISSAL), moment(PLANNED_END))


def tie_break(df: DataFrame) -> list[str]:
    """What orders contracts that start together: file order when the source kept
    it, else the contract id."""
    return [next(c for c in (ORDINAL, CONTRACT) if c in df.columns)]


def _with_islands(history: OrderedHistory) -> OrderedHistory:
    start, end = F.col("_start"), F.col("_end")
    reached = F.col("_reached")
    breaks = reached.isNull() | (reached < start)
    previous_end = F.col("_tail._end")
    opens = previous_end.isNull() | (
        F.col("_breaks") & ~month_cut_continues(previous_end, start)
    )
    return (
        history.max_before("_reached", F.when(end >= start, end))
        .with_column("_breaks", breaks)
        .running_sum("_stretch", F.col("_breaks").cast("bigint"))
        .max_before("_tail", F.struct("_stretch", "_end"))
        .running_sum("_period", opens.cast("bigint"))
    )


def _histories(df: DataFrame, hot_rows: int | None) -> list[OrderedHistory]:
    require_columns(df, [PERSON, CONTRACT, START])
    ties = tie_break(df)
    contracts = df.where(F.col(PERSON).isNotNull() & F.col(START).isNotNull()).select(
        PERSON,
        F.col(CONTRACT).alias("_contract"),
        ntz(F.col(START)).alias("_start"),
        F.coalesce(end_of_contract(df), ntz(_OPEN)).alias("_end"),
        *(F.col(t).alias("_order") for t in ties),
    )
    parts = ordered_histories(contracts, PERSON, ["_start", "_order"], hot_rows)
    return [_with_islands(part) for part in parts]


def contract_periods(df: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row per contract with the number of its period within the person, counted
    from 1: the contract list of every period as rows, however long."""
    return union_all(
        [
            part.rows.select(
                PERSON,
                F.col("_period").alias("PERIODO"),
                F.col("_contract").alias(CONTRACT),
                F.col("_start").alias(START),
            )
            for part in _histories(df, hot_rows)
        ]
    )


def _id_text(history: OrderedHistory) -> Column:
    """Contract ids of a group in order, comma separated."""
    entries = F.sort_array(F.collect_list(F.struct(*history.order, "_contract")))
    return F.array_join(entries["_contract"].cast("array<string>"), ",")


def _group_periods(history: OrderedHistory, with_ids: bool) -> DataFrame:
    bounds = [
        F.min("_start").alias("_from"),
        F.max(F.struct("_stretch", "_end")).alias("_last"),
        F.count("*").alias("N_CONTRATOS"),
    ]
    period = [PERSON, "_period"]
    if history.chunk is None or not with_ids:
        ids = [_id_text(history).alias(CONTRACT)] if with_ids else []
        return history.rows.groupBy(*period).agg(*bounds, *ids)

    # A hot person's period: each chunk's share is made into text first (a chunk is
    # bounded), then the shares are strung together in order.
    shares = history.rows.groupBy(*period, history.chunk).agg(
        *bounds, _id_text(history).alias("_share")
    )
    texts = F.sort_array(F.collect_list(F.struct(history.chunk, "_share")))
    return shares.groupBy(*period).agg(
        F.min("_from").alias("_from"),
        F.max("_last").alias("_last"),
        F.sum("N_CONTRATOS").alias("N_CONTRATOS"),
        F.array_join(texts["_share"], ",").alias(CONTRACT),
    )


def continuous_periods(
    df: DataFrame,
    as_of: str | date,
    with_ids: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Merge each person's contracts into continuous periods.

    Open periods last until ``as_of``. ``IDCONTRATOLABORAL`` holds the ids of all the
    period's contracts in order; ``contract_periods`` gives them as rows. A list too
    long for one cell makes the job fail; nothing is left out."""
    require_columns(df, [PERSON, CONTRACT, START])
    parts = _histories(df, hot_rows)
    periods = union_all([_group_periods(p, with_ids) for p in parts])
    end = F.nullif(F.col("_last._end"), ntz(_OPEN))
    lasting = days_between(F.col("_from"), F.coalesce(end, ntz(as_of))) + 1
    return periods.select(
        PERSON,
        F.col("_from").alias("PERIODO_INICIO"),
        end.alias("PERIODO_FIN"),
        end.isNull().alias("PERIODO_VIGENTE"),
        lasting.cast("bigint").alias("PERIODO_DURACION_DIAS"),
        F.col("N_CONTRATOS"),
        *([F.col(CONTRACT)] if with_ids else []),
    )


def period_count_distribution(periods: DataFrame) -> DataFrame:
    """How many persons have how many continuous periods."""
    return (
        periods.groupBy(PERSON)
        .agg(F.count("*").alias("n_periodos_continuos"))
        .groupBy("n_periodos_continuos")
        .agg(F.count("*").alias("n_personas"))
        .orderBy("n_periodos_continuos")
    )
