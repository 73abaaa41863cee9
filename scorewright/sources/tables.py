"""Reading and writing tables, and keeping intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local runs one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scorewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def keeper(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a DataFrame to the shared folder and reads it back, which ends its lineage."""
    base, count = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", [0]

    def keep(df: DataFrame) -> DataFrame:
        count[0] += 1
        path = f"{base}/{count[0]}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


#: Rows and bytes of texts that a batch for Python may hold.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What is written in here goes to Python in batches that long texts make shorter."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, most in limits.items():
        spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores: a small file is one task, however long the work on its rows takes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
