"""Tables written once on shared storage, so that a lost executor costs no earlier work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session makes that of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cardloom/{uuid.uuid4().hex}"


#: Spark's own settings while a table is written: shuffle files go as soon as the write that made them has ended, Arrow batches are bounded by bytes.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.compression.codec": "zstd"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """While tables are written; no plan whose shuffles a write has made is run again."""
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in a new folder."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
