"""Turns a growing folder of documents into memory cards, as a file stream.

Each document's text is normalised and passes the policy gate: secrets and denied
words block it, personal data is masked. A text that its store has already is
a duplicate. What was decided goes to two tables below ``output``:

- ``cards``: seq, store, kind, title, body, digest, warnings; by batch and store
- ``audit``: seq, store, op (block, empty, too-long, no-id, duplicate) and detail, never the text; by batch and op

The stream takes what is new since its checkpoint and stops. A batch that is
run again, after a crash between a table and the checkpoint, reads the same
files and the same earlier batches, so it writes the same partitions once more.
Of equal texts in one batch the one of least id becomes the card.

Where Spark runs this on much data: texts are hashed where they are read, copies
are merged before they move, and earlier batches are asked for digests alone.

    python -m jobs.ingest_cards --source DOCUMENTS --output FOLDER --checkpoint FOLDER
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import policy
from cardloom.functions.text import first_line, kind_of, normalize

from .common import config, log, main, put, read_or_empty

CARDS = "seq long, kind string, title string, body string, digest string, warnings array<string>, batch long, store string"
AUDIT = "seq long, store string, detail string, batch long, op string"


def judged(docs: DataFrame, settings: dict) -> DataFrame:
    """Per document: seq, store, op (add, block, empty, too-long, no-id), detail, text, digest, warnings."""
    named = docs.select(F.col(settings["id"]).cast("long").alias("seq"), F.coalesce(F.col(settings["store"]).cast("string"), F.lit("global")).alias("store"), normalize(F.coalesce(F.col(settings["text"]), F.lit(""))).alias("t"))
    gated = named.withColumn("g", policy.gate(F.col("t"), settings["deny"], settings["pii"]))
    op = F.when(F.col("seq").isNull(), "no-id").when(F.col("t") == "", "empty").when(~policy.within_bytes(F.col("t"), settings["most_bytes"]), "too-long").when(~F.col("g.ok"), "block").otherwise("add")
    text = F.when(F.col("op") == "add", F.col("g.text"))
    return gated.withColumn("op", op).select("seq", "store", "op", F.when(F.col("op") == "block", F.array_join("g.reasons", ",")).otherwise("").alias("detail"), text.alias("text"), F.sha1(text.cast("binary")).alias("digest"), F.col("g.warnings").alias("warnings"))


def ingest(spark: SparkSession, docs: DataFrame, batch: int, output: str, settings: dict) -> dict:
    """One batch: its cards and its audit, each in place of what an earlier try has written."""
    seen, wrote, noted = Observation(), Observation(), Observation()
    one = F.count(F.lit(1)).alias("n")
    # Judged once for both tables; what a lost executor held is judged again, with the same result.
    rows = judged(docs.observe(seen, one), settings).persist(StorageLevel.DISK_ONLY)
    try:
        fit = rows.where("op = 'add'")
        first = fit.groupBy("store", "digest").agg(F.min_by(F.struct("seq", "text", "warnings"), "seq").alias("x")).select("store", "digest", "x.*")
        earlier = read_or_empty(spark, f"{output}/cards", CARDS).where(F.col("batch") < batch).select("store", "digest")
        number = F.lit(batch).cast("long").alias("batch")
        text = F.col("text")
        new = first.join(earlier, ["store", "digest"], "left_anti").select("seq", kind_of(text).alias("kind"), first_line(text).alias("title"), F.regexp_replace(text, r"\A[^\n]*\n?", "").alias("body"), "digest", "warnings", number, "store")
        put(new.observe(wrote, one), f"{output}/cards", "batch", "store")
        made = read_or_empty(spark, f"{output}/cards", CARDS).where(F.col("batch") == batch).select("store", "digest", "seq")
        again = fit.join(made, ["store", "digest", "seq"], "left_anti").withColumn("op", F.lit("duplicate"))
        rest = rows.where("op <> 'add'").unionByName(again).select("seq", "store", "detail", number, "op")
        put(rest.observe(noted, one), f"{output}/audit", "batch", "op")
    finally:
        rows.unpersist()
    return {"batch": batch, "read": seen.get["n"], "cards": wrote.get["n"], "audited": noted.get["n"]}


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict | None = None) -> dict:
    """Takes in what is new below ``source`` (a folder of Parquet files, or a pattern of folders and files); how many rows each batch has read and written."""
    settings = settings or config("ingest_cards")
    done: list[dict] = []

    def batch(docs: DataFrame, number: int) -> None:
        done.append(ingest(docs.sparkSession, docs, number, output, settings))
        log.info("ingest_cards: batch %(batch)d read %(read)d documents, wrote %(cards)d cards and %(audited)d audit rows", done[-1])

    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_a_batch"]).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    total = {k: sum(d[k] for d in done) for k in ("read", "cards", "audited")}
    log.info("ingest_cards: %d batches from %s to %s, %s", len(done), source, output, total)
    return {"batches": len(done), **total}


def read(spark: SparkSession, output: str) -> DataFrame:
    """Cards and audit together: seq, store, op (add for cards), kind, title, digest, detail."""
    cards = read_or_empty(spark, f"{output}/cards", CARDS).select("seq", "store", F.lit("add").alias("op"), "kind", "title", "digest", F.array_join("warnings", ",").alias("detail"))
    none = F.lit(None).cast("string")
    return cards.unionByName(read_or_empty(spark, f"{output}/audit", AUDIT).select("seq", "store", "op", none.alias("kind"), none.alias("title"), none.alias("digest"), "detail"))


if __name__ == "__main__":
    main("ingest_cards", "Documents to memory cards, incrementally.", {"source": "folder of Parquet documents", "output": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"}, run)
