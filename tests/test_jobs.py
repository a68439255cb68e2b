"""The jobs: against SQL, over input that grows, and run again after a crash."""

import datetime as dt
import json
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from jobs import common, fold_access, ingest_cards, registry

ROOT = Path(__file__).resolve().parents[1]
DOC = "doc_id long, text string, source string"
EVENT = "event_id long, ts timestamp_ntz, user_id long, props string"


def cell(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else v


def rows(df):
    return Counter(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_sql(spark, sf_dir, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.session.timeZone")}
    db = duckdb.connect()
    for t in ("documents", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = db.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = Counter(tuple(cell(v) for _, v in sorted(zip(cols, r, strict=True), key=lambda x: x[0])) for r in cur.fetchall())
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(cols) == sorted(got.columns)
    found = rows(got)
    assert found == want, (list((found - want).items())[:3], list((want - found).items())[:3])
    assert before == {k: spark.conf.get(k, None) for k in before}


def add(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_documents_grow(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    add(spark, [(1, "One fact.", "a"), (2, "One   fact.", "a"), (3, "One fact.", "b"), (4, "password = hunter22", "a"), (5, None, None), (None, "x", "a")], DOC, source)
    assert ingest_cards.run(spark, source, out, mark) == {"batches": 1, "read": 6, "cards": 2, "audited": 4}
    first = rows(ingest_cards.read(spark, out))
    assert ingest_cards.run(spark, source, out, mark)["read"] == 0
    assert rows(ingest_cards.read(spark, out)) == first
    add(spark, [(6, "One fact.", "a"), (7, "I prefer tabs, mail me at a.b@c.org", "a"), (8, "idiot", "b")], DOC, source)
    assert ingest_cards.run(spark, source, out, mark) == {"batches": 1, "read": 3, "cards": 1, "audited": 2}
    got = {(r.seq, r.store): r for r in ingest_cards.read(spark, out).collect()}
    assert {k: r.op for k, r in got.items()} == {(1, "a"): "add", (2, "a"): "duplicate", (3, "b"): "add", (4, "a"): "block", (5, "global"): "empty", (None, "a"): "no-id", (6, "a"): "duplicate", (7, "a"): "add", (8, "b"): "block"}
    assert got[7, "a"].title == "I prefer tabs, mail me at [REDACTED-EMAIL]" and got[7, "a"].kind == "preference" and got[7, "a"].detail == "email"
    assert first == rows(ingest_cards.read(spark, out).where("seq IS NULL OR seq < 6"))
    assert not [r for r in spark.read.parquet(f"{out}/audit").collect() if "hunter22" in str(r)]


def test_documents_after_crash(spark, tmp_path, monkeypatch):
    """Stopped after the cards and before the audit: the next run writes the same batch again."""
    source, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    add(spark, [(1, "One fact.", "a"), (2, "One fact.", "a")], DOC, source)
    put, calls = ingest_cards.put, []

    def fail(df, path, *by):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        put(df, path, *by)

    monkeypatch.setattr(ingest_cards, "put", fail)
    with pytest.raises(Exception, match="stopped"):
        ingest_cards.run(spark, source, out, mark)
    assert spark.read.parquet(f"{out}/cards").count() == 1
    assert ingest_cards.run(spark, source, out, mark)["cards"] == 1
    assert sorted(r.op for r in ingest_cards.read(spark, out).collect()) == ["add", "duplicate"]


def event(n, day, hour, user, card):
    return (n, dt.datetime(2024, 1, day, hour), user, None if card is None else json.dumps({"k": card}))


def test_log_grows(spark, tmp_path):
    log, cards, out = (f"file://{tmp_path}/{n}" for n in ("log", "cards", "out"))
    add(spark, [(1, "Always use tabs.", "a"), (2, "A fact.", "a"), (3, "Unused.", None), (4, None, "b")], DOC, cards)
    settings = common.config("fold_access") | {"promote_sessions": 2, "retention_days": {"fact": 2, "preference": 30}}
    run = lambda: fold_access.run(spark, log, cards, out, settings)
    state = lambda: {r.card: (r.accesses, r.sessions, r.status) for r in spark.read.parquet(f"{out}/state").collect()}
    add(spark, [event(1, 1, 5, 7, 1), event(2, 1, 6, 7, 1), event(3, 3, 1, 8, 2), event(4, 3, 2, 9, None), event(5, 3, 3, 9, 99)], EVENT, log)
    assert run()["events"] == 5
    assert state() == {1: (2, 1, "live"), 2: (1, 1, "live"), 3: (0, 0, "archived"), 4: (0, 0, "archived")}
    first = rows(fold_access.read(spark, out))
    # Nothing new: the days within reach are folded again, with the same result.
    assert run()["events"] == 3 and rows(fold_access.read(spark, out)) == first
    # A late row within reach counts, one beyond it doesn't.
    add(spark, [event(6, 8, 1, 9, 1), event(7, 2, 23, 9, 4), event(8, 1, 1, 5, 2)], EVENT, log)
    assert run()["events"] == 5
    assert state() == {1: (3, 2, "promoted"), 2: (1, 1, "archived"), 3: (0, 0, "archived"), 4: (1, 1, "archived")}
    assert {str(r.day) for r in spark.read.parquet(f"{out}/access").select("day").distinct().collect()} == {"2024-01-01", "2024-01-02", "2024-01-03", "2024-01-08"}


def test_log_after_crash(spark, tmp_path, monkeypatch):
    """Stopped between any two steps and run again, the tables are those of one run."""
    log, cards = f"file://{tmp_path}/log", f"file://{tmp_path}/cards"
    add(spark, [(k, "A fact.", "a") for k in range(4)], DOC, cards)
    add(spark, [event(n, 1 + n % 5, n % 24, n % 3, n % 4) for n in range(60)], EVENT, log)
    whole = f"file://{tmp_path}/whole"
    fold_access.run(spark, log, cards, whole)
    want, put = rows(fold_access.read(spark, whole)), fold_access.put
    for stop in ("access", "state"):
        out = f"file://{tmp_path}/{stop}"

        def fail(df, path, *by, stop=stop):
            if path.endswith(stop):
                raise RuntimeError("stopped")
            put(df, path, *by)

        monkeypatch.setattr(fold_access, "put", fail)
        with pytest.raises(RuntimeError):
            fold_access.run(spark, log, cards, out)
        monkeypatch.setattr(fold_access, "put", put)
        fold_access.run(spark, log, cards, out)
        assert rows(fold_access.read(spark, out)) == want


def test_command_line(sf_dir, tmp_path):
    """The job as a program, twice, on a copy of the log."""
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events.parquet")
    (tmp_path / "c.json").write_text('{"lookback_days": 0}')
    args = ["--events", f"{tmp_path}/events.parquet", "--cards", f"{sf_dir}/documents.parquet", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json"]
    told = []
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.fold_access", *args], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "fold_access: read" in done.stderr
        told.append(json.loads(done.stdout.strip().splitlines()[-1]))
    assert told[0]["events"] == 1000 and 0 < told[1]["events"] < 100 and told[0]["cards"] == told[1]["cards"]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"lookback": 0}')
    with pytest.raises(ValueError, match="lookback"):
        common.config("fold_access", str(tmp_path / "c.json"))
    assert common.config("ingest_cards")["pii"] == "redact"
