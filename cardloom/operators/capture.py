"""Capture: what a user said last, and which of it is meant to be kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import intent_sentences, kind_of, strip_reminders, trim_space

# Fixed value: how a machine-made summary starts.
CHECKPOINT = "This is an automatically generated checkpoint"


def spoken(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants, without machine-made ones."""
    kept = messages.where(F.col("role").isin("user", "assistant"))
    if "source_kind" in messages.columns:
        kept = kept.where(~F.coalesce(F.col("source_kind"), F.lit("")).isin("plugin", "tool"))
    text = trim_space(strip_reminders(F.col("text")))
    return kept.withColumn("text", text).where((text != "") & ~((F.col("role") == "user") & text.startswith(CHECKPOINT)))


def tails(messages: DataFrame, limit: int = 20000, least: int = 120) -> DataFrame:
    """Per session its newest messages up to ``limit`` characters, oldest first.

    A message joins while what is newer is shorter than the limit; the text is
    then cut from its start, which keeps the oldest part.
    """
    newer = Window.partitionBy("session").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chosen = spoken(messages).withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(newer), F.lit(0))).where(F.col("before") < limit)
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), F.lit("\n"))
    users = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    return chosen.groupBy("session").agg(F.count("*").alias("n_messages"), F.substring(text, 1, limit).alias("tail"), F.substring(users, 1, limit).alias("user_tail")).where(F.length(trim_space(F.col("tail"))) >= least)


def candidates(tails_: DataFrame) -> DataFrame:
    """(session, seq, content, kind) from what the user said, five a session at most."""
    found = tails_.select("session", F.posexplode(intent_sentences(F.col("user_tail"))).alias("seq", "content"))
    return found.withColumn("kind", kind_of(F.col("content")))


def content_text(content: F.Column) -> F.Column:
    """Text of a message's blocks (array of struct<type, text>): those of type text, joined by a space."""
    return F.array_join(F.transform(F.filter(content, lambda x: x["type"] == "text"), lambda x: x["text"]), " ")


def eligible(events: DataFrame, *, enabled: bool = True, mode: str = "auto") -> DataFrame:
    """Turn ends to capture from: none unless capture is automatic, and none of delegated sessions."""
    if not enabled or mode != "auto":
        return events.limit(0)
    return events.where((F.col("type") == "turn/end") & (F.coalesce(F.col("delegation_depth"), F.lit(0)) <= 0))


def staged(heuristic: DataFrame, model: DataFrame) -> DataFrame:
    """Candidates of both passes (session, seq, content, kind) in one order: heuristic ones first; ``via`` tells which."""
    both = heuristic.withColumn("via", F.lit("heuristic")).unionByName(model.withColumn("via", F.lit("model")))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy(F.col("via") != "heuristic", "seq")) - 1)
