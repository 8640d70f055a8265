"""Tables in the folder that driver and executors share, for what several steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where none is set (tests on one machine), a local one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


ROWS_PER_PART = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def lean(spark: SparkSession, rows: int, rows_per_part: int = ROWS_PER_PART) -> Iterator[None]:
    """Within it, shuffles have a part for each so many of ``rows``, so that sorts and aggregates stay in memory, and an action's shuffle files go when it ends.

    For steps that end in tables; else an action's files stay until the driver's garbage is collected, and add up.
    """
    wanted = {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_part))), CLEANUP: "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back.

    What several steps use is computed once, and a lost executor costs its own tasks only.
    """
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bucketed(df: DataFrame, name: str, *keys: str, n: int | None = None, dealt: bool = False) -> DataFrame:
    """``as_table``, dealt into ``n`` buckets by ``keys``: joins, windows and aggregates on these keys read it without a shuffle.

    ``n`` is else the number of shuffle partitions. ``dealt`` rows come in ``n`` partitions by these keys already, and are not shuffled again.
    Where one key may hold many rows, name a second one that splits it.
    """
    spark = df.sparkSession
    n, table = n or int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    writer = (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("compression", "zstd")
    writer.option("path", f"{own_folder(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def remove_tables(spark: SparkSession) -> None:
    """Delete what this application has written with ``as_table``. Call it when no result is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
