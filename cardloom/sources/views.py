"""The memory model's tables over the shared test tables, at a fixed clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cards import KINDS

NOW = "2024-02-01 00:00:00"
DENY = ["idiot", "Apache License"]
RETENTION = {"task": 200, "reference": 600}

#: Oracle text of the cards view; the DataFrame below is its equal.
CARDS_SQL = """
cards AS (
  SELECT doc_id, 'm-20240131-' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id,
    CASE doc_id % 4 WHEN 0 THEN 'global' ELSE 'p' || CAST(doc_id % 4 AS VARCHAR) END AS store,
    ['fact','preference','decision','procedure','observation','reference','task'][CAST(doc_id % 7 AS INT) + 1] AS kind,
    [lang, source, 'b' || CAST(n_chars // 1000 AS VARCHAR)] AS tags,
    CAST(doc_id % 10 + 1 AS INT) AS importance, doc_id % 6 AS access_count,
    TIMESTAMP '2024-02-01 00:00:00' - to_days(CAST(doc_id * 37 % 720 AS INT)) AS updated,
    TIMESTAMP '2024-02-01 00:00:00' - to_hours(doc_id * 13 % 500) AS last_accessed,
    CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS valid_until,
    split(text, chr(10))[1] AS title,
    CASE WHEN contains(text, chr(10)) THEN substr(text, length(split(text, chr(10))[1]) + 2) ELSE '' END AS body,
    CAST(round(0.4 + (doc_id % 12) * 0.05, 2) AS DOUBLE) AS confidence, text
  FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    first = F.split("text", "\n")[0]
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("m-20240131-"), F.lpad(d.cast("string"), 10, "0")).alias("id"),
        F.when(d % 4 == 0, F.lit("global")).otherwise(F.concat(F.lit("p"), (d % 4).cast("string"))).alias("store"),
        F.get(F.array(*map(F.lit, KINDS)), (d % 7).cast("int")).alias("kind"),
        F.array("lang", "source", F.concat(F.lit("b"), F.expr("n_chars div 1000").cast("string"))).alias("tags"),
        (d % 10 + 1).cast("int").alias("importance"),
        (d % 6).alias("access_count"),
        (now() - F.make_dt_interval((d * 37 % 720).cast("int"))).alias("updated"),
        (now() - F.make_dt_interval(F.lit(0), (d * 13 % 500).cast("int"))).alias("last_accessed"),
        F.when(d % 11 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("valid_until"),
        first.alias("title"),
        F.substr("text", F.length(first) + 2).alias("body"),
        F.round(0.4 + (d % 12) * 0.05, 2).alias("confidence"),
        "text",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session messages; every third turn states an intent."""
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Remember that "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", said.alias("text"))


MESSAGES_SQL = """
messages AS (SELECT conv_id AS session, turn, role, CASE WHEN turn % 3 = 0 THEN 'Remember that ' || text ELSE text END AS text FROM conversations)"""
