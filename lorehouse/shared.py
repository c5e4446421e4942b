"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables that cut() has written and nothing has deleted yet, by session.
_written: dict[tuple[str, int], list[str]] = {}


def _own(spark: SparkSession) -> list[str]:
    return _written.setdefault((spark.sparkContext.applicationId, spark._jsparkSession.hashCode()), [])


def delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, whose executors are the driver, may go without one that is named."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        said = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(said)
        said = spark.sparkContext.getCheckpointDir()
    return said


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, so that a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/lorehouse-{uuid.uuid4().hex}"
    _own(spark).append(at)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, first: int = 0) -> None:
    """Deletes the tables that cut() wrote in this session, from the first-th on. Only for when no result that reads them is needed any more."""
    own = _own(spark)
    while len(own) > first:
        delete(spark, own.pop())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut within are deleted at the end; what is made of them must have been written by then."""
    first = len(_own(spark))
    try:
        yield
    finally:
        discard(spark, first)
