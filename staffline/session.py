"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("staffline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. A session on one
    machine may leave it out and gets a scratch folder; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if configured is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


# The JVM compiles no method of more bytes; it runs as bytecode, several times slower.
COMPILED_BYTES = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """What runs inside falls back to smaller methods where Spark has fused the steps of
    wide rows into one that the JVM would not compile. The session's own limit is put back."""
    before = spark.conf.get(_METHOD_LIMIT)
    spark.conf.set(_METHOD_LIMIT, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(_METHOD_LIMIT, before)


def staged(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and go on from there: later steps
    read only the columns they need instead of repeating the work behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    with compiled_methods(spark):
        df.write.parquet(path)
    out = spark.read.parquet(path)
    out.staged_at = path
    return out


# Tasks per core that rows are dealt to, so that one slow task does not hold up the rest.
_WAVES = 2


def spread(df: DataFrame) -> DataFrame:
    """Rows that cost more to work on than to move, such as narrow rows that become wide, in
    enough tasks for all cores. Spark deals files out by bytes, a few megabytes at least."""
    tasks = _WAVES * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * tasks else df.repartition(tasks)


def released(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
