"""Records of CSV files whose cells may hold line breaks, found without reading a file whole.

A line read from outside a quoted cell ends outside or inside one, and so does a line read
from inside; a line is a function from two states to two states. Which state a line begins
in follows from the lines before it, and a split of a file can work that out for both
states it may begin in: a line that ends in one state whatever it began with settles the
matter, and the others keep or turn the state, so a count of turns does. Each split then
passes on one small row (its own function, and the number of records it begins in either
case), running values over these rows tell each split its true state and the number of
records before it, and every line its record.

Lines are sent once to the task of their split, in order, and written to the shared folder.
Only lines of records that have several are moved again, to be joined. A record of more
than ``RECORD_LINES`` lines, most likely a quote without its partner, raises."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from staffline.session import staged

RECORD_LINES = 100_000

OUTSIDE, INSIDE = 0, 1

# A cell: quoted, its own quotes doubled; or plain, not beginning with a quote. The
# possessive repeats keep the matcher from stacking up a step for every character.
_QUOTED = r'"(?:[^"]++|"")*+"'
_CELL = rf'(?:{_QUOTED}|[^",][^,]*+|)'
WELL_FORMED = rf'{_CELL}(?:,{_CELL})*+'
_OPEN = r'"(?:[^"]++|"")*+'
_FROM_OUTSIDE = {OUTSIDE: rf"(?s)\A{WELL_FORMED}\z", INSIDE: rf"(?s)\A(?:{_CELL},)*+{_OPEN}\z"}
_REST = r'(?:[^"]++|"")*+'
_FROM_INSIDE = {
    OUTSIDE: rf'(?s)\A{_REST}"(?:,{_CELL})*+\z',
    INSIDE: rf'(?s)\A(?:{_REST}|{_REST}",(?:{_CELL},)*+{_OPEN})\z',
}


def _ends(line: Column, patterns: dict[int, str]) -> Column:
    """The state at the end of a line; null if it follows no rule."""
    return F.when(line.rlike(patterns[OUTSIDE]), OUTSIDE).when(line.rlike(patterns[INSIDE]), INSIDE)


@dataclass(frozen=True)
class Records:
    """``lines``: path, line, at (its place), number (of its record), several (whether the
    record has other lines), head (the number of its file's first record). ``heads``: the first record of each file that follows the rules."""

    lines: DataFrame
    heads: dict[str, str]

    def of(self, paths: Sequence[str]) -> DataFrame:
        """Per record but the first of each file: path, record, at (its first line's), and
        ``own``, true: what looks at records by its leave does so after they are chosen."""
        lines = self.lines
        if set(paths) != self.heads.keys():
            # Written, so that Spark knows its size: a join by path alone puts a file in one task.
            chosen = staged(lines.sparkSession.createDataFrame([(p,) for p in paths], "path string"))
            lines = lines.join(chosen, "path", "left_semi")
        first = F.col("number") > F.col("head")
        alone = lines.where(first & ~F.col("several")).select(
            "path", F.col("line").alias("record"), "at", (first & ~F.col("several")).alias("own"))
        parts = F.sort_array(F.collect_list(F.struct("at", "line")))
        joined = lines.where(first & F.col("several")).groupBy("path", "number").agg(parts.alias("parts")).select(
            "path", F.array_join(F.transform("parts", lambda x: x.line), "\n").alias("record"),
            F.col("parts")[0].at.alias("at"), F.lit(True).alias("own"))
        return alone.unionByName(joined)


def _with_both_states(lines: DataFrame) -> DataFrame:
    """Lines with, for both states their split may begin in, the state they begin in and the
    records begun so far; null ends are bad."""
    quoted = F.contains("line", F.lit('"'))
    from_outside = F.when(~quoted, OUTSIDE).otherwise(_ends(F.col("line"), _FROM_OUTSIDE))
    from_inside = F.when(~quoted, INSIDE).otherwise(_ends(F.col("line"), _FROM_INSIDE))
    lines = lines.withColumns({"end0": from_outside, "end1": from_inside})
    # A line that follows no rule in a state is never to be met in it; any end will do.
    end0, end1 = F.coalesce("end0", F.lit(OUTSIDE)), F.coalesce("end1", F.lit(INSIDE))
    # Columns of their own: windows over fields of a struct each move and sort all lines again.
    lines = lines.withColumns({"block": F.col("at.block"), "row": F.col("at.row"), "blank": F.col("line") == ""})
    split = Window.partitionBy("path", "block").orderBy("row")
    so_far = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = split.rowsBetween(Window.unboundedPreceding, -1)
    turn = ((end0 == INSIDE) & (end1 == OUTSIDE)).cast("int")
    lines = lines.withColumn("turns", F.sum(turn).over(so_far))
    settled = F.when(end0 == end1, F.struct(end0.alias("state"), F.col("turns")))
    lines = lines.withColumn("settled", F.last(settled, ignorenulls=True).over(earlier))
    turned = F.col("turns") - turn
    begins = lambda state: F.when(
        F.col("settled").isNotNull(), F.pmod(F.col("settled.state") + turned - F.col("settled.turns"), F.lit(2))
    ).otherwise(F.pmod(F.lit(state) + turned, F.lit(2)))
    lines = lines.withColumns({f"state{s}": begins(s).cast("int") for s in (OUTSIDE, INSIDE)})
    count = lambda s: F.sum((F.col(f"state{s}") == OUTSIDE).cast("int")).over(so_far)
    lines = lines.withColumns({f"begun{s}": count(s).cast("bigint") for s in (OUTSIDE, INSIDE)})
    return lines.drop("turns", "settled", "block", "row")


def _carries(lines: DataFrame) -> DataFrame:
    """Per split the state it begins in and the records begun before it."""
    ending = lambda s: F.when(F.col(f"state{s}") == OUTSIDE, F.coalesce("end0", F.lit(OUTSIDE))).otherwise(
        F.coalesce("end1", F.lit(INSIDE)))
    last = lambda c: F.max_by(c, F.col("at.row"))
    splits = lines.groupBy("path", F.col("at.block").alias("block")).agg(
        *[last(ending(s)).alias(f"end{s}") for s in (OUTSIDE, INSIDE)],
        *[F.max(f"begun{s}").alias(f"begun{s}") for s in (OUTSIDE, INSIDE)])
    file = Window.partitionBy("path").orderBy("block")
    so_far = file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    turn = ((F.col("end0") == INSIDE) & (F.col("end1") == OUTSIDE)).cast("int")
    splits = splits.withColumn("turns", F.sum(turn).over(so_far))
    settled = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("state"), F.col("turns")))
    splits = splits.withColumn("settled", F.last(settled, ignorenulls=True).over(earlier))
    since = F.col("turns") - turn - F.coalesce("settled.turns", F.lit(0))
    splits = splits.withColumn("state", F.pmod(F.coalesce("settled.state", F.lit(OUTSIDE)) + since, F.lit(2)).cast("int"))
    begun = F.when(F.col("state") == OUTSIDE, F.col("begun0")).otherwise(F.col("begun1"))
    return splits.select("path", "block", "state", F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("before"))


def find_records(lines: DataFrame, files: Sequence[tuple[str, bool, bool]], record_lines: int = RECORD_LINES) -> Records:
    """``lines``: value, path, at (block and row within a file). ``files``: path, whether its
    bytes are latin-1, whether its lines end with CRLF."""
    spark = lines.sparkSession
    kinds = staged(spark.createDataFrame(list(files), "path string, latin1 boolean, crlf boolean"))
    value = F.when(F.col("latin1"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    line = F.when(F.col("crlf"), F.regexp_replace(value, r"\r\z", "")).otherwise(value)
    split = staged(_with_both_states(lines.join(kinds, "path").select("path", "at", line.alias("line"))))
    carries = staged(_carries(split))
    known = split.join(carries.withColumnRenamed("block", "of"), (F.col("at.block") == F.col("of")) & (split["path"] == carries["path"])).drop(carries["path"])
    outside = F.col("state") == OUTSIDE
    begins = F.when(outside, F.col("state0")).otherwise(F.col("state1"))
    known = known.withColumns({"begins": begins, "number": F.col("before") + F.when(outside, F.col("begun0")).otherwise(F.col("begun1"))})
    known = known.withColumn("ends", F.when(F.col("begins") == OUTSIDE, F.col("end0")).otherwise(F.col("end1")))
    known = known.withColumn("several", (F.col("begins") == INSIDE) | (F.col("ends") == INSIDE))
    # The reader skips empty lines between records.
    known = known.where("several or not blank")

    per_record = known.where("several").groupBy("path", "number").agg(F.count("*").alias("n"))
    longest = per_record.groupBy("path").agg(F.max("n").alias("n")).where(F.col("n") > record_lines).first()
    if longest:
        raise ValueError(f"a record of {longest.path} has {longest.n} lines: a quote may lack its partner")
    state = known.groupBy("path").agg(
        F.bool_or(F.col("ends").isNull()).alias("bad"), F.min("number").alias("head"), F.max_by("ends", F.col("at")).alias("last"))
    # A file that ends inside a cell follows no rule, either.
    good = staged(state.where("not bad and last = 0").select("path", "head"))
    numbered = known.select("path", "line", "at", "number", "several").join(good, "path")
    parts = F.sort_array(F.collect_list(F.struct("at", "line")))
    heads = numbered.where("number = head").groupBy("path").agg(parts.alias("parts")).select(
        "path", F.array_join(F.transform("parts", lambda x: x.line), "\n").alias("record")).collect()  # a row per file
    return Records(numbered, {r.path: r.record for r in heads})
