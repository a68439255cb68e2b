"""The n-gram join against brute force, with groups of copies, split blocks and frequent shingles."""

import random

import numpy as np
import pytest

from cardloom.llm import ngramjoin

SCHEMA = "doc_id long, text string, cid int, label string, n int, full string, key string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[top(x)] = top(y)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)] if s else i) for k, (i, s) in enumerate(sets))


def corpus(seed, groups=4, copies=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("xyz")
    texts = [None, "", " \t\x0b", "One", "one", "ONE two three", "one two three four", "a b c d e f g h i", "a b c d e f g h i j", "é 😀 x y z q r s t u v w"]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
            texts.append(" ".join(t))
    shared = " ".join(word() for _ in range(30))
    texts += [shared + " " + " ".join(word() for _ in range(rng.choice([5, 40]))) for _ in range(30)]
    rng.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block,hot,hub", [(2048, 4096, 512), (7, 2, 3)])
def test_brute_force(spark, monkeypatch, block, hot, hub):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "HOT_LEAST", hot)
    monkeypatch.setattr(ngramjoin, "HUB_ROWS", hub)
    if block < 100:
        monkeypatch.setattr(ngramjoin, "BUCKET", 500)
        monkeypatch.setattr(ngramjoin, "PROBE_ROUNDS", 0)
    rows = corpus(block)
    rows += [rows[5], rows[20], rows[20]]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, "y", "z") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.report(docs).collect())
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got) - 50


def test_filters_lose_nothing():
    """Of sets that link, some common prefix place passes the three filters, and few others do."""
    rng = np.random.default_rng(1)
    rule = ngramjoin.Rule()
    none = np.zeros(0, np.int64)
    kept = linked = 0
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 80, dtype=np.uint64) * np.uint64(2)
        x, y = (np.unique(np.r_[rng.choice(base, 80 - (k := int(rng.integers(0, 14))), replace=False), rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for _ in (0, 1))
        both = np.intersect1d(x, y)
        sets = [(0, np.int64(c).tobytes(), b"", s.tobytes(), None) for c, s in ((1, x), (2, y))]
        told = [(0, np.array([1, 2]).tobytes(), np.array([len(both)] * 2, "<u4").tobytes(), both.tobytes() * 2, np.full(2 * len(both), 2, "<u4").tobytes())]
        out = list(ngramjoin._prefixes(iter([ngramjoin._packed_rows(sets + told)]), rule, 1, none, none))
        found = 0
        if out:
            t = out[0]
            cols = {c: t.column(c).to_numpy() for c in ("n", "left")} | {"rest": np.frombuffer(b"".join(t.column("rest").to_pylist()), "<u2").reshape(-1, ngramjoin.CELLS)}
            key, cid = t.column("key").to_numpy(), t.column("cid").to_numpy()
            i, j = np.nonzero((key[:, None] == key[None, :]) & (cid[:, None] < cid[None, :]))
            found = len(ngramjoin._filtered(cols, i, j, rule)[0])
        link = 100 * len(both) >= 85 * len(np.union1d(x, y))
        assert found or not link
        linked += link
        kept += bool(found)
    assert 0 < linked <= kept < 300


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.report(none).count() == 0
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = spark.createDataFrame([("b", long), ("a", long + " tail"), ("c", long[: len(long) // 2]), (None, long.upper())], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in ngramjoin.report(docs).collect()} == {("b", "a"), ("a", "a"), ("c", "c"), (None, "a")}
