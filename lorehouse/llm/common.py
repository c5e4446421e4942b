"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut, discard, scratch, shared_dir  # noqa: F401  (the operators have them from here)

#: A word: a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Spark's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Rows that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of fewer splits than the cluster has cores is dealt out by the hash of its first column, its id, as a small file may be a single row group."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def bound_batches(spark: SparkSession) -> None:
    """Has at most BATCH_ROWS rows and BATCH_BYTES go to a Python worker at a time, in this session from now on: a batch is held by the JVM and by the worker."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size).removesuffix("b") in ("-1", str(64 << 20)):  # not set by anyone
        spark.conf.set(size, str(BATCH_BYTES))


def trimmed(run):
    """run, and at its end what it freed goes back to the system: a worker is used again by other tasks."""

    def trim(batches):
        yield from run(batches)
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return trim


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with `nth`, from 0, its place in an order over all rows: range-sorted, counted by partition, and the counts of the partitions before added."""
    rows = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = rows.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_s")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(shift), "_p").withColumn("nth", F.col("_own") + F.col("_s") - 1).drop("_p", "_own", "_s")
