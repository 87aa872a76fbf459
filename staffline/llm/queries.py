"""The operators applied to the whole test tables, with production parameters."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm import (
    filter_audit, html_text, language_id, mixing, near_copies, packing, periodic_runs, pivot_search, quality_ranker,
    quality_rules, secret_scan, token_files, toxicity,
)
from staffline.llm.oracles import ORACLES  # noqa: F401
from staffline.session import shared_dir, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers of a session started elsewhere must find this package, too.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: str = "source") -> Column:
    """The test sources' domain: src0 to src4 are one, src5 to src9 the next, and so on. A
    source without a number, or with one beyond 64 bits, has its name without the digits."""
    number = F.regexp_extract(F.col(source), r"([0-9]+)$", 1).try_cast("bigint")
    by_number = F.concat(F.lit("domain"), F.call_function("div", number, F.lit(5)).cast("string"))
    return F.coalesce(by_number, F.regexp_replace(F.col(source), r"[0-9]+$", ""))


#: Target weights by domain and language; every source of a branch weighs the same.
MIX = {
    "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
}


def in_fold(n: int, fold: int) -> Column:
    """Whether the CRC-32 of the doc_id as text leaves this remainder by n."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == fold, F.lit(False))


def predicted(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(5, 0)
    ranker = quality_ranker.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return predicted(quality_ranker.scored(docs, ranker), held_out)


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = staged(quality_rules.with_counts(docs).drop("text"))
    judged = quality_rules.judged(counted, quality_rules.cutoffs(counted))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.findings(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    n = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(n, base), F.sha2(secret_scan.span_list(F.col("found"), tuple(base)), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("found")).alias("spans"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, at most two epochs of a leaf: doc_id and epoch of every copy taken."""
    docs = table(spark, sf_dir, "documents")
    chosen = mixing.mixed(docs, domain_of(), 0.5, MIX, max_epochs=2, epoch_column="epoch")
    return chosen.select("doc_id", "lang", "source", "epoch")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    return predicted(toxicity.scored(docs, model), held_out)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language_id.train(docs, remainder != 1)
    return language_id.predicted(docs, model).select("doc_id", in_fold(3, 1).alias("held_out"), "lang_pred", "score")


def with_periods(docs: DataFrame) -> DataFrame:
    """Of the documents whose CRC-32 of the doc_id is a multiple of 10, the words from a place
    a on become copies of the p words there, a and p given by the rest of the CRC-32."""
    words, h = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("_g", F.floor(h / 10)).withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words"))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.expr("int(_g % _n)")))
    chosen = chosen.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    copied = F.expr("transform(_words, (w, i) -> if(i < _a, w, element_at(_words, int(_a + (i - _a) % _p + 1))))")
    text = F.when(F.col("_p").isNull(), F.col("text")).otherwise(F.array_join(copied, " "))
    return chosen.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.with_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_copies": op2_near_copies,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_top_k": op5_top_k,
    "op6_quality_rules": op6_quality_rules,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_language": op11_language,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}
