"""The five calls: remember, recall, forget, status, consolidate.

A ``Memory`` keeps Parquet tables under one folder, each write in a folder of
its own. A numbered manifest names the folders of all tables, the segments of
the index and what of the access logs has been folded. Each change makes the next
number's file, which only one writer can; the other reads the new state and
does its change again. So readers never see half a change, two writers both
survive, and a run that fails leaves the tables as they were.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .functions import policy, score
from .functions.text import card_id, first_line, normalize, normalize_tags, summary_text
from .operators import brief as brief_ops
from .operators import consolidate as ops
from .operators import model
from .operators.index import Index
from .operators.similarity import with_tokens
from .settings import Settings
from .sources import logs
from .sources.scratch import written

CARD = "store string, id string, kind string, tags array<string>, importance int, confidence double, updated timestamp, last_accessed timestamp, access_count long, valid_until timestamp, links array<string>, title string, body string"
#: Folders a table may have, and segments an index, before they are made one.
PARTS = 16
#: Manifests kept behind the newest.
KEPT = 20
_LOCK = threading.Lock()
SUMMARY = "store string, text string"
#: What a run counts.
COUNTED = ("added", "updated", "noop", "blocked", "archived", "relinked")


class PolicyError(ValueError):
    def __init__(self, reasons: list[str]):
        super().__init__("blocked: " + ", ".join(reasons))
        self.reasons = reasons


class Disabled(RuntimeError):
    pass


@dataclass
class Memory:
    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    deny: list[str] = field(default_factory=list)
    retention: dict[str, int] = field(default_factory=dict)
    #: Answers prompts in tasks, so it must be picklable; without one the passes that ask are left out.
    client: model.ModelClient | None = None

    # --- tables ---------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self) -> tuple[int, dict]:
        """The newest manifest and its number."""
        fs, p = self._fs(f"{self.root}/manifests")
        found = sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []
        return (found[-1], json.loads(self.spark.read.text(f"{self.root}/manifests/{found[-1]:012d}").first()[0])) if found else (0, {})

    def _read(self, name: str, manifest: dict, schema: str) -> DataFrame:
        parts = [f"{self.root}/{name}/{v}" for v in manifest.get(name, [])]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def table(self, name: str, schema: str = CARD) -> DataFrame:
        return self._read(name, self._current()[1], schema)

    def _index(self, manifest: dict) -> Index:
        return Index(self.spark, f"{self.root}/index", tuple(manifest.get("index", [])))

    def _write(self, name: str, df: DataFrame) -> str:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{version}")
        return version

    def _publish(self, number: int, manifest: dict) -> bool:
        """Makes the manifest of that number, unless another writer has."""
        fs, path = self._fs(f"{self.root}/manifests/{number:012d}")
        new = self._fs(f"{self.root}/manifests/_{uuid.uuid4().hex}")[1]
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration())
        none = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        with _LOCK:  # between threads; between programs the file system refuses a second file of one name
            try:
                files.rename(new, path, none)
            except Py4JJavaError as e:
                fs.delete(new, False)
                if "AlreadyExists" in e.java_exception.getClass().getName():
                    return False
                raise
        if number > KEPT:
            fs.delete(self._fs(f"{self.root}/manifests/{number - KEPT:012d}")[1], False)
        return True

    def _change(self, make: Callable[[dict], dict]) -> dict:
        """Publishes what ``make`` puts in place of the manifest's entries; made anew for each state that another writer gets in with."""
        while True:
            number, manifest = self._current()
            new = make(manifest)
            if not new or self._publish(number + 1, manifest | new):
                return new

    def _audit(self, rows: DataFrame) -> None:
        logs.append(rows, f"{self.root}/audit")

    # --- calls ----------------------------------------------------------

    def _on(self) -> None:
        if not self.settings.enabled:
            raise Disabled("memory is disabled")

    def remember(self, content: str, now: str, *, kind: str = "fact", tags: list[str] = (), store: str = "global", importance: int = 5) -> dict:
        """A new card, or the reasons why not; a blocked text is a result, an empty or too long one an error."""
        self._on()
        t = self.spark.createDataFrame([(content, list(tags))], "content string, tags array<string>").select(normalize(F.col("content")).alias("t"), normalize_tags(F.col("tags")).alias("tags"))
        g = t.select("t", "tags", policy.gate(F.col("t"), self.deny, self.settings.pii_mode).alias("g"), policy.within_bytes(F.col("t"), self.settings.card_bytes).alias("fits"))
        r = g.first()
        if not r.t:
            raise ValueError("nothing to remember")
        if not r.fits:
            raise ValueError(f"longer than {self.settings.card_bytes} bytes")
        if not r.g.ok:
            self._audit(self.spark.createDataFrame([(store, "block", ",".join(r.g.reasons))], "store string, op string, detail string"))
            return {"id": None, "store": store, "title": None, "blocked": True, "reason": list(r.g.reasons)}
        at = F.lit(now).cast("timestamp")
        text = F.col("g.text")
        card = g.select(
            F.lit(store).alias("store"), card_id(at, text, F.lit(store)).alias("id"), F.lit(kind).alias("kind"), "tags", F.lit(max(1, min(10, importance))).alias("importance"), F.lit(0.6).alias("confidence"),
            at.alias("updated"), at.alias("last_accessed"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("valid_until"), F.array().cast("array<string>").alias("links"),
            first_line(text).alias("title"), F.regexp_replace(text, r"\A[^\n]*\n?", "").alias("body"),
        )
        new = card.first()
        row = self.spark.createDataFrame([new], CARD)

        def put(manifest: dict) -> dict:
            cards = self._read("cards", manifest, CARD)
            old = cards.where((F.col("store") == store) & (F.col("id") == new.id))
            there = old.first()
            if there and (there.title, there.body) != (new.title, new.body):
                raise RuntimeError(f"two texts have the id {new.id}")
            index = self._index(manifest).add(row, old if there else None)
            if len(index.segments) > PARTS:
                index = index.merge()
            if not there and len(manifest.get("cards", [])) < PARTS:
                parts = [*manifest.get("cards", []), self._write("cards", row)]
            else:
                parts = [self._write("cards", cards.join(row.select("store", "id"), ["store", "id"], "left_anti").unionByName(row))]
            return {"cards": parts, "index": list(index.segments)}

        self._change(put)
        return {"id": new.id, "store": store, "title": new.title, "blocked": False, "reason": []}

    def recall(self, query: str, now: str, *, k: int = 8, project: str | None = None, note: bool = True) -> dict:
        """Hits and counts by store; with ``note`` the access is logged, for the next run to fold."""
        self._on()
        manifest = self._current()[1]
        cards = self._read("cards", manifest, CARD)
        stores = ["global", project] if project else ["global"]
        hits = self._ranked(manifest, cards, query, now, k, stores)
        for s in stores if note else []:
            ids = [h.id for h in hits if h.store == s]
            if ids:
                logs.append(self.spark.createDataFrame([(s, ids)], "store string, ids array<string>").coalesce(1).select(F.lit(now).cast("timestamp").alias("ts"), "store", "ids"), self._access(s))
        counts = {r.store: r["count"] for r in cards.where(F.col("store").isin(stores)).groupBy("store").count().collect()}
        return {"hits": [r.asDict() for r in hits], "counts": counts}

    def _ranked(self, manifest: dict, cards: DataFrame, query: str, now: str, k: int, stores: list[str]) -> list:
        return self._index(manifest).recall(cards, query, F.lit(now).cast("timestamp"), k=k, stores=stores).orderBy("rank").collect()

    def _access(self, store: str) -> str:
        """A store's own log of accesses."""
        return f"{self.root}/access/{uuid.uuid5(uuid.NAMESPACE_OID, store).hex}"

    def reindex(self) -> None:
        """The index made anew from the cards, in one segment."""
        self._change(lambda m: {"index": list(Index(self.spark, f"{self.root}/index").add(self._read("cards", m, CARD)).segments)})

    def forget(self, now: str, *, id: str | None = None, query: str | None = None, hard: bool = False, project: str | None = None) -> dict:
        self._on()
        if id:
            from .operators.projects import forget_targets

            rows = forget_targets(self.table("cards"), [id], project).select("store", "id").collect()
        else:
            rows = [(h["store"], h["id"]) for h in self.recall(query or "", now, k=3, project=project, note=False)["hits"]]
        gone: list = []
        if rows:
            keys = self.spark.createDataFrame([tuple(r) for r in rows], "store string, id string")

            def put(manifest: dict) -> dict:
                cards = self._read("cards", manifest, CARD)
                old = cards.join(F.broadcast(keys), ["store", "id"], "left_semi")
                gone[:] = old.select("store", "id").collect()
                if not gone:
                    return {}
                index = self._index(manifest).add(None, old)
                new = {"cards": [self._write("cards", cards.join(F.broadcast(keys), ["store", "id"], "left_anti"))], "index": list((index.merge() if len(index.segments) > PARTS else index).segments)}
                return new if hard else new | {"archive": [*manifest.get("archive", []), self._write("archive", old)]}

            self._change(put)
        if gone:
            done = self.spark.createDataFrame([tuple(r) for r in gone], "store string, id string")
            self._audit(done.select(F.lit(now).cast("timestamp").alias("ts"), "store", F.lit("delete" if hard else "archive").alias("op"), "id"))
        return {"removed": [r.asDict() for r in gone]}

    def status(self, inbox: DataFrame | None = None) -> dict:
        """Cards by store, the last run and the totals of all runs; with an ``inbox`` (store, seq) what of it is still to come."""
        manifest = self._current()[1]
        count = lambda df: {r.store: r["count"] for r in df.groupBy("store").count().collect()}
        live, gone = (count(self._read(t, manifest, CARD)) for t in ("cards", "archive"))
        state = self._read("state", manifest, logs.STATE)
        pending = count(logs.from_offset(inbox, state)) if inbox is not None else {}
        runs = {r.store: r.asDict() for r in state.join(self._read("totals", manifest, logs.TOTALS), "store", "left").collect()}
        of = lambda s: {"last_run": runs[s]["last_run"], "last_result": runs[s]["last_result"], "totals": {k: runs[s][k] or 0 for k in ("runs", *COUNTED)}} if s in runs else {}
        stores = sorted({*live, *gone, *pending, *runs})
        return {"enabled": self.settings.enabled, "schema": 1, "stores": [{"store": s, "cards": live.get(s, 0), "archived": gone.get(s, 0)} | ({"pending": pending.get(s, 0)} if inbox is not None else {}) | of(s) for s in stores]}

    def brief(self, now: str, *, project: str | None = None) -> str:
        """The session's brief: the best cards of the global store and of the project, within the budget; not logged as access."""
        self._on()
        manifest, at, s = self._current()[1], F.lit(now).cast("timestamp"), self.settings
        cards, index = self._read("cards", manifest, CARD), self._index(manifest)
        of = lambda stores, k: index.recall(cards, "", at, k=k, stores=stores)
        own = of(["global", project], s.project_k).where(F.col("store") == project) if project else of(["global"], 1).limit(0)
        return brief_ops.brief(of(["global"], s.global_k), own, project, s.brief_bytes)

    def consolidate(self, inbox: DataFrame, now: str, *, store: str = "global") -> dict:
        """Takes in what of ``inbox`` (seq, content, and kind, tags, importance if there) the store hasn't consumed; folds accesses, decays, archives and links its cards.

        The store's access log is a stream of files. Its batch's number and the inbox
        offset are published together with the tables, so a run that is replayed,
        wherever it was stopped, counts nothing twice and loses nothing; a run that fails
        leaves tables and offsets as they were and its error in the state.
        """
        self._on()
        done: list[dict] = []
        try:
            self._accesses(store, lambda rows, batch: done.append(self._run(inbox, now, store, rows, batch)))
            if not done:  # nothing new in the log, or only what an earlier run has folded
                done.append(self._run(inbox, now, store, self.spark.createDataFrame([], logs.ACCESS), None))
        except Exception as e:
            why = str(e)[:500]

            def put(manifest: dict) -> dict:
                state = self._read("state", manifest, logs.STATE)
                old = state.where(F.col("store") == store).select("store", "inbox_offset", "last_run")
                failed = self.spark.createDataFrame([(store, why)], "store string, last_error string").join(old, "store", "left").select("store", "inbox_offset", "last_run", F.lit("error").alias("last_result"), "last_error")
                return {"state": [self._write("state", state.where(F.col("store") != store).unionByName(failed))]}

            self._change(put)
            raise
        out = done[-1]
        for d in done[:-1]:
            for k in COUNTED:
                out[k] += d[k]
        lines = [f"# Run of {now}", "", f"store: {store}", *(f"- {k}: {out[k]}" for k in COUNTED)]
        logs.write_report(self.spark, f"{self.root}/reports", f"{now}-{store}".replace(" ", "-").replace(":", ""), "\n".join([*lines, ""]))
        return out

    def _accesses(self, store: str, fold: Callable[[DataFrame, int], None]) -> None:
        """Calls ``fold`` with what the store's access log has gained and the batch's number, if that isn't published yet."""
        fs, p = self._fs(self._access(store))
        if not fs.exists(p):
            return

        def batch(rows: DataFrame, number: int) -> None:
            if number > self._current()[1].get("folded", {}).get(store, -1):
                fold(rows, number)

        stream = self.spark.readStream.schema(logs.ACCESS).json(p.toString())
        where = f"{self.root}/checkpoints/{p.getName()}"
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()

    def _run(self, inbox: DataFrame, now: str, store: str, access: DataFrame, batch: int | None) -> dict:
        at = F.lit(now).cast("timestamp")
        told: dict = {}

        def put(manifest: dict) -> dict:
            every, state = self._read("cards", manifest, CARD), self._read("state", manifest, logs.STATE)
            index = self._index(manifest)
            # A run is its store's own affair: the cards of others pass through untouched.
            others, cards = every.where(F.col("store") != store), every.where(F.col("store") == store)
            fresh = logs.from_offset(inbox.withColumn("store", F.lit(store)), state)
            decided = written(ops.ingest(cards, fresh.drop("store"), self.deny, self.settings.pii_mode, index=index if index.segments else None))
            by = ops.bumps(decided).withColumn("store", F.lit(store))
            hit = F.col("by").isNotNull()
            bumped = cards.join(by, ["store", "id"], "left").withColumns({"confidence": F.when(hit, score.bump(F.col("confidence"), F.col("by"))).otherwise(F.col("confidence")), "updated": F.when(hit, at).otherwise(F.col("updated"))}).drop("by")
            minted = written(ops.new_cards(decided, store, at).select(*cards.columns))
            if clash := minted.join(every.select("store", "id"), ["store", "id"], "left_semi").first() or minted.groupBy("id").count().where("count > 1").first():
                raise RuntimeError(f"two texts have the id {clash.id}")
            merged = bumped.select(*cards.columns).unionByName(minted)
            folded = ops.access_fold(merged, access.where(F.col("store") == store).select("ts", "ids")).withColumn("store", F.lit(store))
            merged = ops.patch(merged, folded)
            # Decay looks at the cards as they were when the run began.
            why = cards.select("store", "id", ops.archive_reason(self.retention, at).alias("why")).where("why IS NOT NULL")
            left = written(merged.join(why.select("store", "id"), ["store", "id"], "left_anti"))
            said = self._asked(store, left, self._read("replies", manifest, model.REPLIES)) if self.client else None
            if said:
                why = written(why.unionByName(said["why"]))
                left = left.join(said["why"].select("store", "id"), ["store", "id"], "left_anti")
            gone = written(merged.join(why, ["store", "id"]))
            links = ops.relink(with_tokens(left)).withColumnRenamed("links", "new_links")
            linked = left.join(links, ["store", "id"], "left").withColumn("new_links", F.coalesce("new_links", F.array().cast("array<string>")))
            moved = Observation()
            counted = linked.observe(moved, F.sum((~F.col("links").eqNullSafe(F.col("new_links"))).cast("long")).alias("relinked"))
            kept = counted.withColumn("links", F.col("new_links")).select(*cards.columns)
            version = self._write("cards", kept)
            rest = self._write("cards", others) if others.limit(1).count() else None
            n = {r.action: r["count"] for r in decided.groupBy("action").count().collect()}
            told.clear()
            told.update(added=n.get("add", 0), updated=n.get("update", 0), noop=n.get("noop", 0), blocked=n.get("blocked", 0), archived=gone.count(), relinked=moved.get["relinked"] or 0)
            told["rows"] = (why, decided, minted)
            if told["added"] or told["archived"]:
                index = index.add(minted, gone.drop("why"))
            totals = self._read("totals", manifest, logs.TOTALS)
            one = self.spark.createDataFrame([(store, 1, *(told[k] for k in COUNTED))], logs.TOTALS)
            totals = totals.unionByName(one).groupBy("store").agg(*[F.sum(c).alias(c) for c in ("runs", *COUNTED)])
            new = {
                "cards": [v for v in (version, rest) if v],
                "state": [self._write("state", state.where(F.col("store") != store).unionByName(logs.advance(fresh, state, at).where(F.col("store") == store)))],
                "totals": [self._write("totals", totals.coalesce(1))],
                "index": list((index.merge() if len(index.segments) > 1 else index).segments),
            }
            if told["archived"]:
                new["archive"] = [*manifest.get("archive", []), self._write("archive", gone.select(*cards.columns))]
            if said:
                new["replies"] = [*manifest.get("replies", []), self._write("replies", said["replies"].coalesce(1))]
                old = self._read("summaries", manifest, SUMMARY).join(said["summaries"].select("store"), "store", "left_anti")
                new["summaries"] = [self._write("summaries", old.unionByName(said["summaries"]).coalesce(1))]
            if batch is not None:
                new["folded"] = manifest.get("folded", {}) | {store: batch}
            return new

        self._change(put)
        self._note(store, at, *told.pop("rows"), told)
        return {"started": True, "ts": now, **told}

    def _asked(self, store: str, left: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
        """What the model makes of a store's cards: why some go as losers of a conflict, an overview, and its new replies.

        A model that fails, stalls or says nothing of use changes nothing.
        """
        found = ops.conflicts(with_tokens(left))
        pairs = found.select(F.row_number().over(Window.orderBy("a", "b")).alias("g"), "a", "b", "sim")  # four rows at most
        of = lambda c: left.select(F.col("id").alias(c), F.col("title").alias(f"title_{c}"), F.col("body").alias(f"body_{c}"))
        full = written(F.broadcast(pairs).join(of("a"), "a").join(of("b"), "b"))
        prompts = model.summary_prompts(left).unionByName(model.conflict_prompts(full, store))
        answers, new = model.ask(prompts, self.client, calls=self.settings.model_calls, deadline=self.settings.model_deadline, wall=self.settings.model_seconds, known=known)
        answers = written(answers.where("ok"))
        decided = model.conflict_decisions(answers.where(F.col("key") == f"conflict:{store}").select("text"), full.select("g", "a", "b"))
        lost = decided.join(full.select("g", "a", "b"), "g").where("keep IN ('a', 'b')")
        loser, kept = F.when(F.col("keep") == "a", F.col("b")).otherwise(F.col("a")), F.when(F.col("keep") == "a", F.col("a")).otherwise(F.col("b"))
        why = lost.groupBy(loser.alias("id")).agg(F.min(F.concat(F.lit("llm-conflict(kept "), kept, F.lit(")"))).alias("why")).select(F.lit(store).alias("store"), "id", "why")
        summaries = answers.where(F.col("key") == f"summary:{store}").select(F.lit(store).alias("store"), summary_text(F.col("text")).alias("text")).where("text IS NOT NULL")
        return {"why": written(why), "summaries": summaries, "replies": new}

    def _note(self, store: str, at: F.Column, why: DataFrame, decided: DataFrame, minted: DataFrame, counts: dict) -> None:
        """What the run did, for the audit: ids and actions, never texts."""
        null = F.lit(None).cast("string")
        row = lambda df, op, id, detail: df.select(at.alias("ts"), F.lit(store).alias("store"), F.lit(op).alias("op"), id.alias("id"), detail.alias("detail"))
        of = lambda action: decided.where(F.col("action") == action)
        rows = row(why, "archive", F.col("id"), F.col("why")).unionByName(row(of("blocked"), "block", null, F.array_join("reasons", ",")))
        rows = rows.unionByName(row(of("update"), "update", F.col("target"), F.format_string("dedup-jaccard %.2f", "sim"))).unionByName(row(minted, "create", F.col("id"), null))
        done = ", ".join(f"{k}={counts[k]}" for k in COUNTED)
        rows = rows.unionByName(row(self.spark.range(1), "run", null, F.lit(done)))
        self._audit(rows.coalesce(1))
