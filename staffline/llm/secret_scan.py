"""Secret scans with a ledger of what has been scanned.

Every version of every text is known by its content, as the SHA-256 of its UTF-8 bytes.
The ledger is a Parquet table of (blob, rule, version, spans); a blob is scanned with a
rule only if the ledger has no row for that blob under the rule's present version. A scan
with no finding is a row as well, so it is not repeated. Changing a rule means raising its
version: the blobs are then scanned with that rule alone. Findings are joined back to all
paths and historical versions that hold the blob, so a thousand copies cost one scan.

The texts to scan are looked up by the digest of one row per blob; their shuffle is the
only one that moves texts. A blob's findings are one row, whatever the number of its
paths; paths are joined to them by digest. Rows that repeat both id and text meet in one
task, which scans the first of them.

A span is ``kind:start:end`` in code points, end exclusive. Within a rule, matches are
leftmost and do not overlap; matches that are too short are dropped after matching.
Nulls: a null text is an empty one. Empty tables give empty results. Repeated rows each
get their findings. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.session import staged


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` must have ``least`` characters for the match to count."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values. The first three are the base rules, in this order.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    found = re.compile(rule.pattern, re.ASCII).finditer(text)
    return [m.span() for m in found if len(m[rule.group]) >= rule.least]


def with_blob(versions: DataFrame, text: str = "text") -> DataFrame:
    """The content address of each row's text, 32 bytes."""
    return versions.withColumn("_blob", F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)))


def _pairs(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")


def scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``texts``: _blob, _text, _kinds (the rules to apply), rows of a blob in one partition.
    One row per blob and rule."""
    by_kind = {r.kind: r for r in rules}

    def run(batches):
        seen: set[bytes] = set()  # of one partition
        for batch in batches:
            rows = []
            for blob, text, kinds in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if blob in seen:
                    continue
                seen.add(blob)
                for kind in kinds:
                    spans = [list(x) for x in find(by_kind[kind], text)]
                    rows.append((blob, kind, by_kind[kind].version, spans))
            blobs, kinds, versions, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.binary()), pa.array(kinds, pa.string()), pa.array(versions, pa.int32()),
                 pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["blob", "kind", "version", "spans"])

    return texts.select("_blob", "_text", "_kinds").mapInArrow(
        run, "blob binary, kind string, version int, spans array<array<int>>")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(versions: DataFrame, ledger: str | None, rules: tuple[Rule, ...] = RULES,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what the ledger at this path lacks, append it there, and return the ledger's
    rows for these rules. Without a path the ledger is empty and kept for this call."""
    spark = versions.sparkSession
    known = read_ledger(spark, ledger) if ledger else None
    keyed = with_blob(versions.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")), "_text")
    blobs = keyed.groupBy("_blob").agg(F.min("_key").alias("_least"))
    current = F.array(*[F.lit(r.kind) for r in rules])
    if known is None:
        todo = blobs.withColumn("_kinds", current)
    else:
        done = known.join(_pairs(spark, rules), ["kind", "version"], "left_semi").groupBy("blob").agg(F.collect_set("kind").alias("done"))
        todo = blobs.join(done, F.col("_blob") == F.col("blob"), "left").select(
            "_blob", "_least", F.array_except(current, F.coalesce("done", F.array().cast("array<string>"))).alias("_kinds"),
        ).where(F.size("_kinds") > 0)
    # Keys may repeat or be null, so the row to scan is one that has the blob itself.
    todo = todo.select(F.col("_blob").alias("_todo"), "_least", "_kinds").hint("shuffle_hash")
    texts = keyed.join(todo, F.col("_key").eqNullSafe(F.col("_least")) & (F.col("_blob") == F.col("_todo")))
    fresh = scan(texts.select("_blob", F.coalesce("_text", F.lit("")).alias("_text"), "_kinds"), rules)
    if ledger is None:
        return staged(fresh)
    fresh.write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger).join(_pairs(spark, rules), ["kind", "version"], "left_semi")


FOUND = "array<struct<start:int,rank:int,kind:string,end:int>>"


def findings(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``versions`` its key, ``blob`` and ``found``: kind, start and end of every
    finding, ordered by start, then by the order of the rules."""
    rows = update_ledger(versions, ledger, rules, key, text)
    order = F.lit(0)
    for at, rule in enumerate(rules):
        order = F.when(F.col("kind") == rule.kind, at).otherwise(order)
    spans = F.transform("spans", lambda s: F.struct(s[0].alias("start"), order.alias("rank"), F.col("kind"), s[1].alias("end")))
    # Few rows have findings; repeated rows of a text may be scanned twice.
    once = rows.where(F.size("spans") > 0).groupBy("blob", "kind").agg(F.first("spans").alias("spans"))
    by_blob = staged(once.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("found")))
    paths = with_blob(versions.select(F.col(key), F.col(text).cast("string").alias("_text")), "_text").drop("_text")
    return paths.join(by_blob.withColumnRenamed("blob", "_of"), F.col("_blob") == F.col("_of"), "left").select(
        F.col(key), F.lower(F.hex("_blob")).alias("blob"),
        F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def span_list(found, kinds: tuple[str, ...] | None = None):
    """Spans as text, comma-joined; of some kinds only, if given."""
    if kinds:
        found = F.filter(found, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


REPLACEMENT = "[SECRET]"


def redacted(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """The documents with every secret in their texts replaced; other columns as they were.

    Spans of several rules that overlap or touch are replaced as one."""
    spans = findings(docs, ledger).where(F.size("found") > 0)
    by_doc = spans.groupBy(F.col("doc_id").alias("_scan_id"), F.unhex("blob").alias("_scan_blob")).agg(F.first("found").alias("_scan_found"))
    names = docs.columns
    keyed = with_blob(docs).join(
        staged(by_doc), F.col("doc_id").eqNullSafe(F.col("_scan_id")) & (F.col("_blob") == F.col("_scan_blob")), "left")
    no_spans = F.array().cast("array<struct<start:int,end:int>>")

    def join_spans(acc, s):
        last = F.element_at(acc, -1)
        own = F.struct(s.start.alias("start"), s.end.alias("end"))
        longer = F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"))
        # get() of the empty list is null, and so is the comparison.
        touches = F.coalesce(F.get(acc, F.size(acc) - 1).end >= s.start, F.lit(False))
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(own)))

    keyed = keyed.withColumn("_scan_spans", F.aggregate(F.coalesce("_scan_found", F.array().cast(FOUND)), no_spans, join_spans))
    end = lambda i: F.when(i > 0, F.get("_scan_spans", i - 1).end).otherwise(0)
    before = F.transform("_scan_spans", lambda s, i: F.substring("text", end(i) + 1, s.start - end(i)))
    after = F.substring("text", end(F.size("_scan_spans")) + 1, F.length("text"))
    clean = F.when(F.size("_scan_spans") == 0, F.col("text")).otherwise(F.array_join(F.concat(before, F.array(after)), REPLACEMENT))
    return keyed.select(*[clean.alias("text") if c == "text" else F.col(c) for c in names])
