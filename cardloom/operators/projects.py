"""Projects, stores and their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug


def register(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Upserts ``seen`` (path, ts) into ``known`` (slug, path, first_seen, last_seen); a taken slug gets -2, -3 and on."""
    now_ = seen.groupBy("path").agg(F.min("ts").alias("f"), F.max("ts").alias("l"))
    old = known.join(now_, "path", "left").select("slug", "path", "first_seen", F.greatest("last_seen", F.coalesce("l", "last_seen")).alias("last_seen"))
    fresh = now_.join(known, "path", "left_anti").withColumn("base", slug(F.col("path")))
    taken = known.withColumn("base", F.regexp_replace("slug", "-[0-9]+$", "")).groupBy("base").agg(F.count("*").alias("c"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("f", "path")) + F.coalesce("c", F.lit(0))
    new = fresh.join(taken, "base", "left").select(F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("slug"), "path", F.col("f").alias("first_seen"), F.col("l").alias("last_seen"))
    return old.unionByName(new)


def resolve(cwds: DataFrame, projects: DataFrame, levels: int = 12) -> DataFrame:
    """The nearest registered ancestor of each ``cwd``, up to 12 levels, by an equi-join on ancestors."""
    parts = F.split("cwd", "/")
    up = F.transform(F.sequence(F.lit(0), F.least(F.lit(levels - 1), F.size(parts) - 2)), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))
    each = cwds.select("cwd", F.posexplode(up).alias("level", "path"))
    return each.join(projects.select("path", "slug"), "path").groupBy("cwd").agg(F.min_by("slug", "level").alias("slug"))


def status(cards: DataFrame, inbox: DataFrame, state: DataFrame, archive: DataFrame) -> DataFrame:
    """Per store: cards, superseded ones, waiting inbox rows, archived cards, last run."""
    c = cards.groupBy("store").agg(F.count("*").alias("cards"), F.count("valid_until").alias("superseded"))
    waiting = inbox.join(state.select("store", "inbox_offset"), "store", "left").where(F.col("seq") >= F.coalesce("inbox_offset", F.lit(0))).groupBy("store").agg(F.count("*").alias("pending"))
    a = archive.groupBy("store").agg(F.count("*").alias("archived"))
    n = lambda k: F.coalesce(k, F.lit(0)).cast("long").alias(k)
    return c.join(waiting, "store", "left").join(a, "store", "left").join(state.select("store", "last_run"), "store", "left").select("store", "cards", "superseded", n("pending"), n("archived"), "last_run")


def forget_targets(cards: DataFrame, ids: list[str], project: str | None) -> DataFrame:
    """For each id the first store that has it: the project's, then the global one."""
    order = Window.partitionBy("id").orderBy(F.when(F.col("store") == F.lit(project), 0).otherwise(1))
    return cards.where(F.col("id").isin(ids) & F.col("store").isin([s for s in (project, "global") if s])).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
