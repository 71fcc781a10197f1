"""Tables written once and read by several parts of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written_path(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Where that setting is missing, a temporary folder serves in local mode; on
    a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/lexloom"
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table, read back: what follows doesn't compute it again, and lost executors lose nothing."""
    spark, schema = df.sparkSession, df.schema
    path = written_path(spark)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def one_thread(spark: SparkSession) -> None:
    """Python workers that start from now on use one thread for a matrix product: a machine runs as many tasks as it has cores."""
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")


#: Rows that Python workers get at a time; Spark's own default is 10,000 of them, however long the texts are.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Python workers get BATCH_ROWS rows at a time, and those that start from now on give freed memory back; a session with a setting of its own keeps it."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(BATCH_ROWS))
    for name, value in (("MALLOC_ARENA_MAX", "1"), ("MALLOC_TRIM_THRESHOLD_", str(32 << 20)), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        spark.sparkContext.environment.setdefault(name, value)
