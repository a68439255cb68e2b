"""Append-only logs and the state between runs, as JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INBOX = "ts timestamp, store string, seq long, content string, kind string, tags array<string>, importance int, source struct<session:string,turn:int>, via string"
ACCESS = "ts timestamp, store string, ids array<string>"
AUDIT = "ts timestamp, store string, op string, id string, detail string, via string, session string"
#: What a store has consumed and its last run: its result, and how often anything was done in it over all runs.
STATE = "store string, inbox_offset long, last_run timestamp, last_result string, last_error string"
TOTALS = "store string, runs long, added long, updated long, noop long, blocked long, archived long, relinked long"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append(df: DataFrame, path: str) -> None:
    """One file a task, so writers never interleave."""
    df.write.mode("append").json(path)


def from_offset(inbox: DataFrame, state: DataFrame) -> DataFrame:
    """Rows not yet consumed in their store."""
    return inbox.join(state.select("store", "inbox_offset"), "store", "left").where(F.col("seq") >= F.coalesce("inbox_offset", F.lit(0))).drop("inbox_offset")


def dirty(inbox: DataFrame, state: DataFrame) -> DataFrame:
    return from_offset(inbox, state).select("store").distinct()


def advance(inbox: DataFrame, state: DataFrame, now: F.Column) -> DataFrame:
    """The state after a run that consumed ``inbox``."""
    done = inbox.groupBy("store").agg((F.max("seq") + 1).alias("o"))
    return state.join(done, "store", "full").select("store", F.greatest("inbox_offset", "o").alias("inbox_offset"), now.cast("timestamp").alias("last_run"), F.lit("ok").alias("last_result"), F.lit(None).cast("string").alias("last_error"))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that may not exist yet."""
    fs, p = _path(spark, path)
    return read_jsonl(spark, path, schema) if fs.exists(p) else spark.createDataFrame([], schema)


def clear(spark: SparkSession, path: str) -> None:
    """Empties a log that has been folded."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def write_report(spark: SparkSession, folder: str, name: str, text: str, keep: int = 10) -> None:
    """A run's report as ``report-<name>.md``; the newest ``keep`` by name stay."""
    fs, p = _path(spark, f"{folder}/report-{name}.md")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    found = sorted(x.getPath().getName() for x in fs.listStatus(p.getParent()) if x.getPath().getName().startswith("report-"))
    for old in found[:-keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), old), False)
