"""Intermediate tables in the folder that all executors share (spark.checkpoint.dir).

A written table is how these operators cut lineage: it outlives lost executors, and each later job
reads what was committed rather than computing it anew.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import importable

#: Bytes that a broadcast table may hold, by its counted rows and the widths of its columns (digests and names are taken to be so wide); more are joined by shuffle.
BROADCAST_BYTES, TEXT_BYTES = 24 << 20, 40
#: Bytes of a batch that a Python worker is given at a time, whatever the length of its rows.
ARROW_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; where it names none (tests), one of our own. Batches for Python are bounded from then on."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries started inside delete their shuffle files when they end, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back; the shuffle files that made them are deleted."""
    path = new_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a written table that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if it is a counted table of few bytes; otherwise left to a shuffle join."""
    width = sum({"bigint": 8, "double": 8, "int": 4, "boolean": 1, "tinyint": 1}.get(f.dataType.simpleString(), TEXT_BYTES) for f in df.schema)
    return F.broadcast(df) if (df.count() if rows is None else rows) * width <= BROADCAST_BYTES else df


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not when the driver next collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
