"""The index against a rebuild and against ranking by scan; the ranking against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import index, recall
from cardloom.operators.similarity import with_tokens

CARD = "store string, id string, kind string, tags array<string>, importance int, updated timestamp, last_accessed timestamp, access_count long, valid_until timestamp, title string, body string"
NOW = "2026-02-01 00:00:00"


def make(spark, rows):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(s, i, t, g, n) for s, i, t, g, n in rows], "store string, id string, body string, tags array<string>, n int")
    return df.select("store", "id", F.lit("fact").alias("kind"), "tags", (F.col("n") % 10 + 1).alias("importance"), (at + F.make_dt_interval(F.col("n") % 20)).alias("updated"), at.alias("last_accessed"), F.lit(0).cast("long").alias("access_count"), F.when(F.col("n") % 13 == 0, at).alias("valid_until"), F.lit("note").alias("title"), "body")


def card(rng, k):
    words = [rng.choice(["red", "green", "blue", "cat", "dog", "sun", f"w{rng.randrange(40)}", "记忆"]) for _ in range(rng.choice([0, 3, 12]))]
    return (f"s{k % 3}", f"m{k:04d}", " ".join(words), rng.choice([None, [], ["Red"], ["red", "RED", "cat"]]), rng.randrange(100))


def tables(ix):
    p = sorted(map(tuple, ix.postings().select("bucket", "field", "term", "store", "id", "tf", "len").collect()))
    return p, sorted((r.store, r.id, r.len, sorted(r.set)) for r in ix.docs().collect()), sorted(map(tuple, ix.stats().select("store", "cards", "tokens").collect()))


def test_changes_equal_rebuild(spark, tmp_path):
    """Inserts, new texts under an old id and archives, in segments, then merged."""
    rng = random.Random(3)
    live = {(r := card(rng, k))[:2]: r for k in range(60)}
    ix = index.build(spark, str(tmp_path / "ix"), make(spark, live.values()))
    for k in range(20):
        how = k % 3
        if how == 0:
            new, old = [card(rng, 100 + k)], []
        elif how == 1:
            old = [live[rng.choice(sorted(live))]]
            new = [(*old[0][:2], "changed words red", ["cat"], 5)]
        else:
            new, old = [], [live[x] for x in rng.sample(sorted(live), 2)]
        ix = ix.add(make(spark, new) if new else None, make(spark, old) if old else None)
        for r in old:
            live.pop(r[:2])
        live |= {r[:2]: r for r in new}
    cards = make(spark, live.values())
    want = tables(index.build(spark, str(tmp_path / "again"), cards))
    assert tables(ix) == want
    merged = ix.merge()
    assert len(merged.segments) == 1 and tables(merged) == want
    terms = recall.query_terms(spark, "red cat 记忆 nothing")
    scan = {(r.store, r.id): round(r.rel, 9) for r in recall.relevance(with_tokens(cards), terms).collect()}
    for found in (ix, merged):
        assert {(r.store, r.id): round(r.rel, 9) for r in found.relevance(cards, terms).collect()} == scan
    for query, stores in (("red cat", None), ("", ["s1"]), ("nothing", None)):
        assert [tuple(r) for r in merged.recall(cards, query, F.lit(NOW).cast("timestamp"), k=5, stores=stores).collect()] == [tuple(r) for r in recall.recall(cards, query, F.lit(NOW).cast("timestamp"), k=5, stores=stores).collect()]


def test_plan_reads_buckets_of_the_query(spark, tmp_path, capsys):
    rng = random.Random(1)
    ix = index.build(spark, str(tmp_path / "ix"), make(spark, [card(rng, k) for k in range(40)]))
    ix.postings(["red", "cat"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), In(term" in plan or "Or(EqualTo(term" in plan, plan
    assert ix.postings(["red"]).select("bucket").distinct().count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_of_thousand(spark, monkeypatch, seed):
    """From a pool of very few, the checks find what the loop over all cards finds."""
    monkeypatch.setattr(recall, "POOL", 6)
    monkeypatch.setattr(recall, "ADDED", 5)
    rng = random.Random(seed)
    rows = [(f"s{k % 2}", f"m{k:04d}", round(rng.random(), rng.choice([1, 6])), sorted(rng.sample(range(30), rng.randint(0, 12)))) for k in range(1000)]
    left, chosen = {r[:2]: r for r in rows}, []
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    while len(chosen) < 20:
        best = min(left.values(), key=lambda r: (-round(0.3 * r[2] - 0.7 * max((sim(r[3], c[3]) for c in chosen), default=0.0), 9), -r[2], r[0], r[1]))
        chosen.append(best)
        del left[best[:2]]
    pool = spark.createDataFrame(rows, "store string, id string, score double, set array<bigint>")
    assert [(r.store, r.id) for _, r in recall.diverse(pool, 20)] == [c[:2] for c in chosen]


def test_empty(spark, tmp_path):
    cards = make(spark, [card(random.Random(1), 1)]).limit(0)
    ix = index.build(spark, str(tmp_path / "ix"), cards)
    assert ix.recall(cards, "red", F.lit(NOW).cast("timestamp")).count() == 0 and recall.recall(cards, "red", F.lit(NOW).cast("timestamp")).count() == 0
