"""The model as a bounded, fallible function."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..sources.scratch import written


@dataclass
class Reply:
    ok: bool
    text: str = ""
    reason: str = ""
    truncated: bool = False


class ModelClient(Protocol):
    def complete(self, system: str, prompt: str, max_tokens: int, temperature: float) -> tuple[str, str]:
        """Text and stop reason: end or max-tokens."""


def call(client: ModelClient | None, system: str, prompt: str, *, max_tokens: int = 2000, deadline: float = 60.0) -> Reply:
    """Never raises, and returns by the deadline even if the client doesn't."""
    if client is None:
        return Reply(False, reason="no-service")
    said: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            said.put((client.complete(system, prompt, max_tokens, 0.2), None))
        except Exception as e:  # the caller's pass goes on without the model
            said.put((None, e))

    # A daemon, so that a client that never returns holds up neither the task nor the worker's end.
    threading.Thread(target=run, daemon=True).start()
    try:
        got, error = said.get(timeout=max(0.0, deadline))
    except queue.Empty:
        return Reply(False, reason="timeout")
    if error is not None:
        return Reply(False, reason=f"error: {error}")
    text, stop = got
    if not text.strip():
        return Reply(False, reason=stop if stop == "max-tokens" else "empty")
    return Reply(True, text, truncated=stop == "max-tokens")


class Budget:
    """At most so many calls a run."""

    def __init__(self, calls: int = 40):
        self.left = calls

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


REPLIES = "hash string, text string"


def ask(prompts: DataFrame, client: ModelClient | None, *, calls: int = 40, deadline: float = 60.0, wall: float = 600.0, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``prompts`` (key, system, prompt, max_tokens) to answers (key, ok, text, reason) and new replies (hash, text), both from written tables.

    Prompts are asked where they lie, each partition with its own budget of calls
    and of time; what is beyond either has the reason "budget". A prompt that
    ``known`` (hash, text) has a reply to is not asked again, so a run that is
    repeated asks only what the one before didn't get to.
    """
    rows = prompts.withColumn("hash", F.sha2(F.concat_ws("\x1f", "system", "prompt"), 256))
    open_ = rows if known is None else rows.join(known.select("hash"), "hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget, end = Budget(calls), time.monotonic() + wall
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                left = end - time.monotonic()
                reply = call(client, r.system, r.prompt, max_tokens=int(r.max_tokens), deadline=min(deadline, left)) if left > 0 and budget.take() else Reply(False, reason="budget")
                out.append((r.hash, reply.ok, reply.text, reply.reason))
            yield pd.DataFrame(out, columns=["hash", "ok", "text", "reason"])

    asked = written(open_.select("hash", "system", "prompt", "max_tokens").dropDuplicates(["hash"]).mapInPandas(run, "hash string, ok boolean, text string, reason string"))
    new = asked.where("ok").select("hash", "text")
    told = asked if known is None else asked.unionByName(known.select("hash", F.lit(True).alias("ok"), "text", F.lit("").alias("reason")))
    return rows.select("key", "hash").join(told, "hash").select("key", "ok", "text", "reason"), new


SUMMARY_SYSTEM = "Write an overview of the notes below in at most 120 words of plain prose: what holds, what is preferred, what has been decided. Say nothing that the notes don't say. Answer NONE if there is nothing to tell."
CONFLICT_SYSTEM = "Each group below holds two notes that may contradict each other. For each group answer with one line: its name, then A or B for the note that should stay, or both if they can stand together."


def summary_prompts(cards: DataFrame, least: int = 8) -> DataFrame:
    """A prompt for each store with so many live cards: key (the store), system, prompt, max_tokens."""
    lines = summary_input(cards).select("store", "rank", F.format_string("- [%s] %s: %s — %s", "kind", "id", "title", excerpt(F.col("body"))).alias("line"))
    told = lines.groupBy("store").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines")).where(F.size("lines") >= least)
    return told.select(F.concat(F.lit("summary:"), "store").alias("key"), F.lit(SUMMARY_SYSTEM).alias("system"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"), F.lit(400).alias("max_tokens"))


def conflict_prompts(pairs: DataFrame, store: str) -> DataFrame:
    """One prompt for a store's few ``pairs``, as ``conflict_prompt`` takes them."""
    told = conflict_prompt(pairs).agg(F.array_sort(F.collect_list(F.struct("g", "prompt"))).alias("p")).where(F.size("p") > 0)
    return told.select(F.lit(f"conflict:{store}").alias("key"), F.lit(CONFLICT_SYSTEM).alias("system"), F.array_join(F.transform("p", lambda x: x["prompt"]), "\n\n").alias("prompt"), F.lit(200).alias("max_tokens"))


def summary_input(cards: DataFrame, most: int = 40) -> DataFrame:
    """Per store its most important live cards."""
    order = Window.partitionBy("store").orderBy(F.col("importance").desc(), "id")
    return cards.where("valid_until IS NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def excerpt(body: Column, most: int = 160) -> Column:
    return F.substring(collapse(body), 1, most)


def conflict_prompt(pairs: DataFrame) -> DataFrame:
    """``pairs`` (g, a, title_a, body_a, b, title_b, body_b, sim) to (g, prompt)."""
    return pairs.select("g", F.format_string("G%d (%.2f)\nA %s: %s — %s\nB %s: %s — %s", "g", "sim", "a", "title_a", excerpt(F.col("body_a")), "b", "title_b", excerpt(F.col("body_b"))).alias("prompt"))


def conflict_decisions(replies: DataFrame, pairs: DataFrame) -> DataFrame:
    """``replies`` (text) against ``pairs`` (g, a, b) to (g, keep): a, b or both; the first line of a group wins."""
    rows = replies.select(F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).select("pos", F.trim("line").alias("line"))
    pat = r"^G([0-9]+)\s*:?\s*(\S+)"
    said = rows.where(F.col("line").rlike(pat)).select("pos", F.regexp_extract("line", pat, 1).cast("int").alias("g"), F.regexp_extract("line", pat, 2).alias("v"))
    bare = F.regexp_replace("v", "[.,;:!?，。；：！？]+$", "")
    tail = lambda c: (F.length(bare) >= 8) & (F.endswith(F.col(c), bare) | F.endswith(bare, F.col(c)))
    low = F.lower("v")
    keep = F.when(low == "both", "both").when(F.col("v") == F.col("a"), "a").when(F.col("v") == F.col("b"), "b").when(low == "a", "a").when(low == "b", "b").when(tail("a"), "a").when(tail("b"), "b")
    return said.join(pairs.select("g", "a", "b"), "g").withColumn("keep", keep).where("keep IS NOT NULL").groupBy("g").agg(F.min_by("keep", "pos").alias("keep"))
