"""The calls and the streams, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from cardloom import streaming
from cardloom.api import Disabled, Memory
from cardloom.operators import capture, consolidate, recall
from cardloom.operators.similarity import with_tokens
from cardloom.settings import Settings
from cardloom.sources import logs

NOW = "2026-01-10 12:00:00"


def test_calls(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), deny=["Forbidden"])
    a = m.remember("deploys run on friday evenings", NOW, tags=["Ops"])
    b = m.remember("the parser drops trailing commas", NOW, store="proj")
    assert not a["blocked"] and a["title"] == "deploys run on friday evenings"
    denied = m.remember("a forbidden word", NOW)
    assert denied["blocked"] and denied["id"] is None and denied["reason"] == ["rule:never:Forbidden"]
    with pytest.raises(ValueError):
        m.remember("  \n ", NOW)
    with pytest.raises(ValueError):
        m.remember("x" * 5000, NOW)
    got = m.recall("friday deploys", NOW, project="proj")
    assert [h["id"] for h in got["hits"]][0] == a["id"] and got["counts"] == {"global": 1, "proj": 1}
    assert [h["id"] for h in m.recall("parser", NOW)["hits"]] == [a["id"]]  # another store's card isn't seen
    assert m.forget(NOW, id=b["id"], project="proj")["removed"] == [{"store": "proj", "id": b["id"]}]
    assert m.forget(NOW, id=b["id"], project="proj")["removed"] == []
    assert m.status()["stores"] == [{"store": "global", "cards": 1, "archived": 0}, {"store": "proj", "cards": 0, "archived": 1}]
    m.forget(NOW, id=a["id"], hard=True)
    assert m.table("cards").count() == 0 and m.table("archive").count() == 1


def test_disabled(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), Settings(enabled=False))
    for call in (lambda: m.remember("x", NOW), lambda: m.recall("x", NOW), lambda: m.forget(NOW, id="x")):
        with pytest.raises(Disabled):
            call()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_ingest_and_replay(spark, tmp_path):
    """Against a loop that takes the rows one by one."""
    m = Memory(spark, str(tmp_path / "m"))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    first = m.remember(base, NOW)["id"]
    rows = [(0, base), (1, base.replace("kappa", "lambda")), (2, "one two three four five"), (3, "one two three four six"), (4, "one two three four five"), (5, "wholly other words here")]
    inbox = spark.createDataFrame(rows, "seq long, content string")
    known, want = {first: set(base.split())}, {}
    for seq, text in rows:
        s = set(text.split())
        best = max(known, key=lambda k: jaccard(known[k], s))
        sim = jaccard(known[best], s)
        want[seq] = ("noop" if sim >= 0.85 else "update" if sim >= 0.6 else "add", best if sim >= 0.6 else None)
        if sim < 0.6:
            known[f"#{seq}"] = s
    decided = consolidate.ingest(m.table("cards"), inbox, [])
    assert {r.seq: (r.action, r.target) for r in decided.collect()} == want
    run = m.consolidate(inbox, NOW)
    assert (run["added"], run["updated"], run["noop"], run["blocked"]) == tuple(sum(v[0] == k for v in want.values()) for k in ("add", "update", "noop", "blocked"))
    n = m.table("cards").count()
    assert n == len(known) and m.consolidate(inbox, NOW)["added"] == 0 and m.table("cards").count() == n


def test_run(spark, tmp_path):
    """Replaying changes no column; accesses are folded once, a failed run leaves all but its error, a brief fits."""
    m = Memory(spark, str(tmp_path / "m"), deny=["Forbidden"])
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    a = m.remember(text, NOW)["id"]
    m.remember(text, NOW, store="proj")
    inbox = spark.createDataFrame([(0, text), (1, "forbidden words"), (2, "one two three four five")], "seq long, content string")
    m.recall("alpha", NOW)
    m.recall("alpha", NOW)
    first = m.consolidate(inbox, "2026-01-11 12:00:00")
    assert (first["added"], first["noop"], first["blocked"]) == (1, 1, 1)
    rows = {(r.store, r.id): r for r in m.table("cards").collect()}
    assert rows["global", a].access_count == 2 and rows["global", a].confidence == 0.62
    assert [r.confidence for k, r in rows.items() if k[0] == "proj"] == [0.6]
    again = m.consolidate(inbox, "2026-01-12 12:00:00")
    assert (again["added"], again["noop"], again["blocked"], again["relinked"]) == (0, 0, 0, 0)
    assert {(r.store, r.id): r for r in m.table("cards").collect()} == rows
    with pytest.raises(Exception):
        m.consolidate(inbox.select("seq"), NOW)
    state = m.table("state", logs.STATE).first()
    assert (state.inbox_offset, state.last_result) == (3, "error") and {(r.store, r.id): r for r in m.table("cards").collect()} == rows
    audit = logs.read_jsonl(spark, f"{tmp_path}/m/audit", logs.AUDIT).collect()
    assert [(r.op, r.detail) for r in audit if r.op == "block"] == [("block", "rule:never:Forbidden")]
    assert [r.id for r in audit if r.op == "create"] == [i for (_, i), r in rows.items() if r.title == "one two three four five"]
    runs = [r.detail for r in sorted(audit, key=lambda r: r.ts) if r.op == "run"]
    assert runs == [f"added={a}, updated=0, noop={a}, blocked={a}, archived=0, relinked=0" for a in (1, 0)] and not [r for r in audit if text in str(r)]
    told = {s["store"]: s for s in m.status(inbox.withColumn("store", F.lit("proj")))["stores"]}
    assert told["global"]["totals"] == {"runs": 2, "added": 1, "updated": 0, "noop": 1, "blocked": 1, "archived": 0, "relinked": 0}
    assert told["global"]["last_result"] == "error" and told["global"]["pending"] == 0 and told["proj"]["pending"] == 3
    assert len(list((tmp_path / "m" / "reports").glob("report-*.md"))) == 2
    for k in range(12):
        logs.write_report(spark, f"{tmp_path}/m/reports", f"9{k:02d}", "x")
    assert len(list((tmp_path / "m" / "reports").glob("report-*.md"))) == 10
    got = m.brief(NOW, project="proj")
    assert len(got.encode()) <= m.settings.brief_bytes and a in got


def test_staging(spark):
    blocks = spark.createDataFrame([([("text", "a"), ("image", "x"), ("text", "b")],)], "content array<struct<type:string,text:string>>")
    assert blocks.select(capture.content_text(F.col("content"))).first()[0] == "a b"
    events = spark.createDataFrame([("turn/end", 0), ("turn/end", 1), ("other", 0), ("turn/end", None)], "type string, delegation_depth int")
    assert capture.eligible(events).count() == 2 and capture.eligible(events, mode="explicit").count() == 0
    one = spark.createDataFrame([("s", 0, "x", "fact"), ("s", 1, "y", "fact")], "session string, seq int, content string, kind string")
    assert [(r.seq, r.content, r.via) for r in capture.staged(one, one.where("seq = 0")).orderBy("seq").collect()] == [(0, "x", "heuristic"), (1, "y", "heuristic"), (2, "x", "model")]
    cards = spark.createDataFrame([("g", "a", 0.9, 1), ("g", "b", 0.5, 1)], "store string, id string, confidence double, importance int")
    patched = consolidate.patch(cards, spark.createDataFrame([("g", "b", 0.85, None)], "store string, id string, confidence double, importance int"))
    assert {(r.id, r.confidence, r.importance) for r in patched.collect()} == {("a", 0.9, 1), ("b", 0.85, 1)}
    seen = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("b", "s1"), ("b", "s2")], "id string, session string")
    assert [r.id for r in consolidate.promoted(patched, seen).collect()] == ["b"]


def test_ranking(spark):
    """The greedy ranking against a loop over all candidates."""
    texts = ["red green blue", "red green blue", "red green yellow", "cat dog", "cat dog bird", "sun"]
    cards = spark.createDataFrame([("global", f"c{i}", "fact", "", t, 1.0 - i / 10) for i, t in enumerate(texts)], "store string, id string, kind string, title string, body string, score double")
    got = [r.id for r in recall.mmr(with_tokens(cards), 6).orderBy("rank").collect()]
    left, chosen = list(range(len(texts))), []
    while left:
        best = max(left, key=lambda i: (round(0.3 * (1.0 - i / 10) - 0.7 * max((jaccard(set(texts[i].split()), set(texts[j].split())) for j in chosen), default=0.0), 9), -i))
        chosen.append(best)
        left.remove(best)
    assert got == [f"c{i}" for i in chosen]


def drained(stream, path):
    q = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def test_streams(spark, tmp_path):
    events = [("s1", "2026-01-01 00:00:00"), ("s1", "2026-01-01 00:00:10"), ("s1", "2026-01-01 00:00:40"), ("s2", "2026-01-01 00:00:05")]
    df = spark.createDataFrame(events, "session string, ts string").select("session", F.col("ts").cast("timestamp").alias("ts"))
    want = {("s1", 2, "00:00:25"), ("s1", 1, "00:00:55"), ("s2", 1, "00:00:20")}
    assert {(r.session, r.n_events, r.fires_at.strftime("%H:%M:%S")) for r in streaming.debounced(df).collect()} == want
    df.coalesce(1).write.json(str(tmp_path / "in"))
    drained(streaming.once_per_key(spark.readStream.schema("session string, ts timestamp").json(str(tmp_path / "in")), "session"), tmp_path)
    assert sorted(r.session for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["s1", "s2"]


def test_incremental(spark, tmp_path):
    """Each inbox row is consumed once, also over a second start."""

    def put(seq):
        spark.createDataFrame([(seq, f"text {seq}")], "seq long, content string").coalesce(1).write.mode("append").json(str(tmp_path / "inbox"))

    def consume():
        q = streaming.consolidate(streaming.inbox_stream(spark, str(tmp_path / "inbox")), str(tmp_path / "ck"), lambda df: df.select("seq", "content"), str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(1)
    assert consume() == [1]
    assert consume() == [1]
    put(2)
    assert consume() == [1, 2]


@pytest.mark.parametrize("block", [3, 512])
def test_links_of_large_and_small_tag_lists(spark, monkeypatch, block):
    """Against a plain loop: hot lists in several blocks, lists within others, repeated tags, no tags, no words, ties."""
    monkeypatch.setattr(consolidate, "BLOCK", block)
    rng = random.Random(5)
    rows = []
    for i in range(90):
        tags = ["a", "b", "c"] if i % 3 == 0 else rng.sample("abcdef", rng.randint(0, 5)) + ["a"] * (i % 2)
        rows.append((f"s{i % 5 == 4}", f"m{i:03d}", tags if i != 7 else None, rng.sample("uvwxyz", rng.randint(0, 5))))
    cards = spark.createDataFrame(rows, "store string, id string, tags array<string>, tokens array<string>")
    got = {(r.store, r.id): r.links for r in consolidate.relink(cards).collect()}
    want = {}
    for s, i, tags, words in rows:
        found = []
        for s2, j, tags2, words2 in rows:
            m = len(set(tags or ()) & set(tags2 or ()))
            if s == s2 and i != j and m >= 2:
                u, v = set(words), set(words2)
                found.append((-round(m * 10 + (len(u & v) / len(u | v) if u and v else 0.0), 9), j))
        if found:
            want[s, i] = [j for _, j in sorted(found)[:5]]
    assert got == want


def test_store_of_its_own(spark, tmp_path):
    """A run leaves other stores' cards alone, and keeps what an inbox row says of its card."""
    m = Memory(spark, str(tmp_path / "m"), retention={"task": 5})
    for s in ("global", "proj"):
        m.remember("an old task", "2025-01-01 00:00:00", kind="task", store=s)
    m.recall("task", NOW, project="proj")
    inbox = spark.createDataFrame([(0, "use tabs in makefiles", "preference", ["Make", "tabs"], 9), (1, "other words stand here", "nothing", None, None)], "seq long, content string, kind string, tags array<string>, importance int")
    out = m.consolidate(inbox, NOW)
    assert (out["added"], out["archived"]) == (2, 1)
    rows = {r.body or r.title: r for r in m.table("cards").collect()}
    assert [(r.store, r.access_count) for r in rows.values() if r.title == "an old task"] == [("proj", 0)]
    assert (rows["use tabs in makefiles"].kind, rows["use tabs in makefiles"].tags, rows["use tabs in makefiles"].importance) == ("preference", ["Make", "tabs"], 9)
    assert (rows["other words stand here"].kind, rows["other words stand here"].importance) == ("fact", 5)
    assert [(r.store, r.access_count) for r in m.table("archive").collect()] == [("global", 1)]
    # The other store's accesses wait for its own run.
    assert m.consolidate(inbox.limit(0), NOW, store="proj")["archived"] == 1
    assert {(r.store, r.access_count) for r in m.table("archive").collect()} == {("global", 1), ("proj", 1)}
    assert {(h["title"], h["store"]) for h in m.recall("tabs words", NOW, note=False)["hits"]} == {("use tabs in makefiles", "global"), ("other words stand here", "global")}
    m.reindex()
    assert len(m.recall("tabs words", NOW, note=False)["hits"]) == 2


@pytest.mark.parametrize("stop", ["_write", "_publish", "_note"])
def test_stopped_anywhere(spark, tmp_path, monkeypatch, stop):
    """A run stopped before, at and after its publication and run again counts every access and row once."""
    m = Memory(spark, str(tmp_path / "m"))
    a = m.remember("alpha beta gamma", NOW)["id"]
    m.recall("alpha", NOW)
    inbox = spark.createDataFrame([(0, "alpha beta gamma"), (1, "wholly other words")], "seq long, content string")
    whole, calls = getattr(Memory, stop), []

    def fail(self, *args):
        calls.append(args)
        if len(calls) == 1:
            raise RuntimeError("stopped")
        return whole(self, *args)

    monkeypatch.setattr(Memory, stop, fail)
    with pytest.raises(Exception, match="stopped"):
        m.consolidate(inbox, "2026-01-11 12:00:00")
    m.recall("beta", NOW)  # comes between the two runs
    m.consolidate(inbox, "2026-01-11 12:00:00")
    m.consolidate(inbox, "2026-01-11 12:00:00")
    cards = {r.id: r for r in m.table("cards").collect()}
    assert len(cards) == 2 and cards[a].confidence == 0.62
    assert sum(r.access_count for r in cards.values()) == sum(len(r.ids) for r in logs.read_jsonl(spark, f"{tmp_path}/m/access/*", logs.ACCESS).collect())
    assert cards[a].access_count == 2


def test_two_writers(spark, tmp_path):
    """Changes made at once all survive."""
    import threading

    m = Memory(spark, str(tmp_path / "m"))
    texts = [f"text number {k} of several" for k in range(6)]
    failed = []

    def put(t):
        try:
            m.remember(t, NOW)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=put, args=(t,)) for t in texts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(r.title for r in m.table("cards").collect()) == sorted(texts)
    assert {h["title"] for h in m.recall("several", NOW, note=False)["hits"]} == set(texts)
    again = m.remember(texts[0], NOW)
    assert m.table("cards").count() == len(texts) and again["title"] == texts[0]


def test_model_passes(spark, tmp_path):
    """The loser of a conflict is archived, an overview kept; what was answered isn't asked again, and a stalled model ends in time."""
    import time

    log = tmp_path / "asked"

    class Client:
        def __init__(self, how):
            self.how = how

        def complete(self, system, prompt, max_tokens, temperature):
            with open(log, "a") as f:
                f.write(prompt.split("\n")[0] + "\n")
            if self.how == "stall":
                time.sleep(30)
            if self.how == "fail":
                raise RuntimeError("no model")
            return ("G1: A\nG2 both\nG9 a" if prompt.startswith("G1") else " An  overview\nof notes. ", "end")

    m = Memory(spark, str(tmp_path / "m"), Settings(model_deadline=1.0), client=Client("stall"))
    texts = ["the build runs on linux with python three", "the build runs on windows with python two", "the build runs on linux with java now", *(f"note{k} x{k} y{k} z{k}" for k in range(7))]
    ids = {t: m.remember(t, f"2026-01-0{1 + k % 8} 12:00:00")["id"] for k, t in enumerate(texts)}
    none = spark.createDataFrame([], "seq long, content string")
    pairs = [(r.a, r.b) for r in consolidate.conflicts(with_tokens(m.table("cards"))).collect()]
    assert len(pairs) == 3 and {i for p in pairs for i in p} == {ids[t] for t in texts[:3]}
    began = time.monotonic()
    assert m.consolidate(none, NOW)["archived"] == 0 and time.monotonic() - began < 60
    m.client = Client("fail")
    assert m.consolidate(none, NOW)["archived"] == 0 and m.table("summaries", "store string, text string").count() == 0
    m.client = Client("answer")
    assert len(log.read_text().splitlines()) == 4
    assert m.consolidate(none, NOW)["archived"] == 1
    assert [r.id for r in m.table("archive").collect()] == [pairs[0][1]]
    assert [(r.store, r.text) for r in m.table("summaries", "store string, text string").collect()] == [("global", "An overview of notes.")]
    audit = {r.op: r for r in logs.read_jsonl(spark, f"{tmp_path}/m/audit", logs.AUDIT).where("op = 'archive'").collect()}
    assert audit["archive"].detail == f"llm-conflict(kept {pairs[0][0]})"
    m.consolidate(none, NOW)  # one card fewer: both prompts are new, and the next pair's loser goes
    m.consolidate(none, NOW)
    asked = len(log.read_text().splitlines())
    m.consolidate(none, NOW)
    assert len(log.read_text().splitlines()) == asked and m.table("archive").count() == 2


def test_conflicts_in_order(spark, monkeypatch):
    """The first pairs in order, from steps of few cards, against all pairs."""
    monkeypatch.setattr(consolidate, "FIRST_CARDS", 3)
    rng = random.Random(2)
    rows = [(f"m{k:03d}", rng.sample("abcdefghijklmnopqrstuvw", rng.randint(0, 9))) for k in range(60)]
    cards = spark.createDataFrame(rows, "id string, tokens array<string>").withColumn("valid_until", F.lit(None).cast("timestamp"))
    want = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if 0.3 <= jaccard(set(x), set(y)) < 0.85]
    for most in (1, 4, 25, 10_000):
        assert [(r.a, r.b) for r in consolidate.conflicts(cards, most).collect()] == want[:most]
