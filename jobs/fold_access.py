"""Folds an access log into daily counts, and these into the state of every card.

The log (``events``) says when which session used which card; it only grows.
Tables below ``output``:

- ``access``: a row a day, card and session with n and last_ts; by day
- ``mark``: the latest time a run has seen
- ``state``: a row a card: accesses, sessions, last use, and whether it is
  promoted, live or archived; by store

A run reads the log from the day ``lookback_days`` before its mark on and puts
these days in place of what they held, then adds its mark, then makes the state
anew from the daily counts. Days before that are not read again; events that come
later than that are not counted. Each step writes the same when it is repeated, so
a run that was cut short is simply started again.

Where Spark runs this on much data: the filter on time reaches the scan; a card
that has a third of all accesses is summed a task at a time before rows move; the
state reads daily counts, not the log.

    python -m jobs.fold_access --events EVENTS --cards DOCUMENTS --output FOLDER
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.text import kind_of, normalize

from .common import config, log, main, put, read_or_empty

ACCESS = "card long, session string, n long, last_ts timestamp_ntz, day date"
MARK = "seen timestamp_ntz"
STATE = "card long, kind string, accesses long, sessions long, last_ts timestamp_ntz, status string, store string"


def daily(events: DataFrame, settings: dict) -> DataFrame:
    """``events`` to a row a day, card and session; what names no card is left out."""
    named = events.select(F.expr(settings["card"]).alias("card"), F.col(settings["session"]).cast("string").alias("session"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return named.where("card IS NOT NULL AND ts IS NOT NULL").groupBy(F.to_date("ts").alias("day"), "card", "session").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select("card", "session", "n", "last_ts", "day")


def state(cards: DataFrame, access: DataFrame, settings: dict) -> DataFrame:
    """Every card with its uses; the clock is the log's latest time.

    A card that many sessions use is promoted; one not used for longer than its
    kind is kept for, or never, is archived. Ids that repeat count as one card, that of
    the greatest store.
    """
    known = cards.select(F.col(settings["id"]).cast("long").alias("card"), F.coalesce(F.col(settings["store"]).cast("string"), F.lit("global")).alias("store"), kind_of(normalize(F.coalesce(F.col(settings["text"]), F.lit("")))).alias("kind"))
    known = known.groupBy("card").agg(F.max(F.struct("store", "kind")).alias("x")).select("card", "x.*")
    # First by session, so that a card all sessions use is merged before it moves.
    by_session = access.groupBy("card", "session").agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"))
    uses = by_session.groupBy("card").agg(F.sum("n").alias("accesses"), F.count(F.lit(1)).alias("sessions"), F.max("last_ts").alias("last_ts"))
    clock = access.agg(F.max("last_ts").alias("clock"))
    full = known.join(uses, "card", "left").crossJoin(F.broadcast(clock))
    keep = F.lit(None).cast("double")
    for kind, days in settings["retention_days"].items():
        keep = F.when(F.col("kind") == kind, F.lit(float(days))).otherwise(keep)
    idle = (F.unix_micros(F.col("clock").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 86_400_000_000
    status = F.when(F.coalesce("sessions", F.lit(0)) >= settings["promote_sessions"], "promoted").when(F.col("last_ts").isNull() | (idle > keep), "archived").otherwise("live")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.select("card", "kind", zero("accesses"), zero("sessions"), "last_ts", status.alias("status"), "store")


def run(spark: SparkSession, events: str, cards: str, output: str, settings: dict | None = None) -> dict:
    """Folds what the log has gained; how many events were read, and rows written."""
    settings = settings or config("fold_access")
    mark = read_or_empty(spark, f"{output}/mark", MARK).agg(F.max("seen")).first()[0]
    told = spark.read.parquet(events)
    if mark is not None:
        start = mark.replace(hour=0, minute=0, second=0, microsecond=0)
        told = told.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(settings['lookback_days'])} DAYS"))
    seen, folded, made = Observation(), Observation(), Observation()
    days = daily(told.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last")), settings)
    put(days.observe(folded, F.count(F.lit(1)).alias("n")), f"{output}/access", "day")
    if seen.get["n"]:
        spark.createDataFrame([(seen.get["last"],)], MARK).coalesce(1).write.mode("append").parquet(f"{output}/mark")
    access = read_or_empty(spark, f"{output}/access", ACCESS)
    put(state(spark.read.parquet(cards), access, settings).observe(made, F.count(F.lit(1)).alias("n")), f"{output}/state", "store")
    out = {"events": seen.get["n"], "since": mark, "daily": folded.get["n"], "cards": made.get["n"]}
    log.info("fold_access: read %(events)d events (mark %(since)s), wrote %(daily)d daily rows and the state of %(cards)d cards", out)
    return out


def read(spark: SparkSession, output: str) -> DataFrame:
    """State and daily counts together; ``part`` tells which."""
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    s = spark.read.schema(STATE).parquet(f"{output}/state").select(F.lit("state").alias("part"), "card", "store", "kind", none("string", "session"), none("date", "day"), F.col("accesses").alias("n"), "sessions", "last_ts", "status")
    a = read_or_empty(spark, f"{output}/access", ACCESS).select(F.lit("access").alias("part"), "card", none("string", "store"), none("string", "kind"), "session", "day", "n", none("bigint", "sessions"), "last_ts", none("string", "status"))
    return s.unionByName(a)


if __name__ == "__main__":
    main("fold_access", "Access log to daily counts and card states, incrementally.", {"events": "Parquet access log", "cards": "Parquet documents", "output": "folder of the tables"}, run)
