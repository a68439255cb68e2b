"""What the operators share: the scratch folder, written tables, array helpers.

Lineage is cut by writing Parquet into the folder named by
``spark.checkpoint.dir``; executors may be lost at any time without losing
these tables, since they lie on storage that all machines share.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: everything but space, tab, LF, VT, FF and CR.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder.

    Only where the setting is absent and all runs in one process (tests, a
    laptop) a local folder is made and put into the session, so that later
    calls find the same one; a cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cardloom/{uuid.uuid4().hex}"


#: Spark's own settings while a table is written: shuffle files go as soon as the write that made them has ended,
#: and Arrow batches are bounded by bytes, since rows may carry whole texts or sets.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the scratch folder and read back.

    The write's shuffle files go at its end: nothing runs the same plan again,
    and while it runs they serve tasks that are repeated.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove what finished writes have broadcast.

    It goes once the driver's JVM has collected the plans that made it, which
    an idle driver may put off for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving freed memory back at a task's end.

    Arrow takes its memory from the system, whose allocator can be trimmed. Spark hands tasks to its idle Python workers in turn, so all of them stay
    beside the executor's heap with whatever their allocators hold on to.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no such call outside glibc
            pass

    return task


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    return [f"_{i}" for i in range(n + len(taken)) if f"_{i}" not in taken][:n]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(lengths: Column, block: int = 64) -> Column:
    """Inclusive prefix sums of an array of longs in O(n * block).

    Built-in array functions have no scan; summing blocks first keeps long
    arrays from costing the square of their length.
    """

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def scan(xs: Column) -> Column:
        n_blocks = F.ceil(F.size(xs) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
        sums = F.transform(blocks, total)
        return let(
            F.struct(blocks.alias("b"), sums.alias("s")),
            lambda z: F.flatten(
                F.transform(
                    z["b"],
                    lambda blk, i: let(
                        total(F.slice(z["s"], F.lit(1), i)),
                        lambda before: F.transform(blk, lambda _, k: before + total(F.slice(blk, F.lit(1), k + 1))),
                    ),
                )
            ),
        )

    empty = F.array().cast("array<bigint>")
    return let(lengths, lambda xs: F.when(F.size(xs) > 0, scan(xs)).otherwise(empty))


def with_offsets(parts: DataFrame, part: str, count: str, out: str) -> DataFrame:
    """One row per partition with the total of ``count`` before it.

    ``parts`` has one row per task that wrote data, so the single-partition
    window holds as many rows as there were tasks, never rows of the corpus.
    """
    from pyspark.sql import Window

    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, F.coalesce(F.sum(count).over(before), F.lit(0)).cast("long").alias(out))
