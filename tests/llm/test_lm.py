"""Operator 7: base figures against brute force, the model by its held-out score."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from cardloom.llm import lm

ROWS = [(1, "The the THE end", 1), (2, None, 1), (3, "", 1), (3, "É the\tzz\x00q", 1), (3, "É the\tzz\x00q", 1), (None, "null id", 1)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.createDataFrame(ROWS, "doc_id long, text string, block int").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 100 doc_id", "text", "1 block")).repartition(3).cache()


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_and_model(docs):
    rows = [(r.doc_id, tokens(r.text)) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(t for d, ts in rows if not held(d) for t in ts)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + 1 * (v + 1))) for t in ts), 6)) for d, ts in rows)
    got = lm.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in got)
    assert lm.score(docs.limit(0)).count() == 0


def test_distribution(spark):
    """In every context the averaged probabilities of all known words and one unknown sum to 1, a spread context's too."""
    rng = np.random.default_rng(0)
    contexts, words = (np.sort(rng.integers(1, 1 << 63, n, dtype=np.uint64)) for n in (20, 41))
    heavy, buckets = contexts[3:4], 3
    count = rng.integers(1, 300, (20, 41)) * (rng.random((20, 41)) < 0.3)
    count[:, 40] = 0
    u, w, c = np.repeat(contexts, 41), np.tile(words, 20), count.ravel().astype(np.uint32)
    b = lm._bucket(u, w, buckets, heavy)
    assert len(set(b[u == heavy[0]])) == buckets and all(len(set(b[u == x])) == 1 for x in contexts if x != heavy[0])
    blobs = []
    for k in range(buckets):
        own = b == k
        at, runs = lm._runs(u[own])
        blobs.append((k, lm.packed(lm._rising(u[own][at]), runs.astype(np.uint32), w[own], c[own])))
    known, m, totals, _ = lm.fit(spark.createDataFrame(blobs, "bucket int, data binary"), buckets, heavy, int((count.sum(0) > 0).sum()))
    none = lambda kind: F.lit(None).cast(kind)
    asked = spark.createDataFrame(blobs, "bucket int, data binary").select(F.lit(lm._ASKED).alias("kind"), "bucket", none("int").alias("wb"), F.lit(1).cast("long").alias("block"), none("long").alias("u"), none("long").alias("x"), "data")
    answers = known.unionByName(asked).groupBy("bucket").applyInArrow(lm._answers(m, totals, buckets, heavy), "block long, bucket int, data binary").collect()
    p = np.empty(len(u))
    for r in answers:
        p[b == r.bucket] = lm.unpacked(bytes(r.data))[0]
    assert (p > 0).all() and len(totals) == lm.ROUNDS - lm.BURN_IN
    assert np.allclose(p.reshape(20, 41).sum(1), 1, atol=1e-5)


def test_spread_contexts(docs, monkeypatch):
    """Base figures and coverage stay the same when common words are spread over buckets and blocks are small."""
    want = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "HEAVY", 1 / 50)
    assert {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(docs).collect()} == want


def test_stirling():
    """The recurrence against counting seatings, the saddle point against the recurrence."""
    d = 0.6

    def weight(c, t, sizes=()):
        """Sum over all ways to seat c customers at t tables of the product of (size - d)."""
        if not c:
            return float(len(sizes) == t)
        total = weight(c - 1, t, (*sizes, 1)) if len(sizes) < t else 0.0
        return total + sum((s - d) * weight(c - 1, t, (*sizes[:i], s + 1, *sizes[i + 1 :])) for i, s in enumerate(sizes))

    for c in range(1, 7):
        for t in range(1, c + 1):
            assert math.isclose(weight(c, t), math.exp(lm.stirling(d)[c, t]), rel_tol=1e-9)
    big = lm.stirling(d, 400)
    for c in (80, 400):
        t = np.arange(1, c - 1)
        off = lm.log_stirling(np.full(len(t), float(c)), t.astype(float), d) - big[c, 1 : c - 1]
        assert np.abs(off[: lm.FEW]).max() < 1e-6 and np.abs(off[c // 4 :]).max() < 0.08 and np.abs(np.diff(off[lm.FEW :])).max() < 0.05


def test_tables():
    """Tables of a dish: taking customers out and reseating them one by one gives the same distribution."""
    d, theta, p, other, c = 0.5, 2.0, 0.05, 30, 40
    rng = np.random.default_rng(1)
    sizes, seen = [c], []
    for step in range(60_000):
        k = rng.choice(len(sizes), p=np.array(sizes) / c)
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
        odds = np.array([s - d for s in sizes] + [(theta + d * (other + len(sizes))) * p])
        k = rng.choice(len(odds), p=odds / odds.sum())
        sizes = [*sizes, 1] if k == len(sizes) else [s + (i == k) for i, s in enumerate(sizes)]
        if step > 2000:
            seen.append(len(sizes))

    def draw(c, t, n, small):
        before, lm.SMALL = lm.SMALL, small
        try:
            out = np.full(n, t)
            for _ in range(1 if c <= small else 12):
                out = lm.draw_tables(np.full(n, c), np.full(n, other), np.full(n, p), out, d, theta, rng)
            return out
        finally:
            lm.SMALL = before

    exact, steps = draw(c, 1, 20_000, 64), draw(c, 1, 20_000, 8)
    assert abs(exact.mean() - np.mean(seen)) < 0.25 and abs(exact.std() - np.std(seen)) < 0.25
    assert abs(steps.mean() - exact.mean()) < 0.1 and abs(steps.std() - exact.std()) < 0.1
    c, t = 10**5, np.arange(1.0, 2000)  # against the whole conditional
    log = lm.log_stirling(np.full(len(t), float(c)), t, d) + t * np.log(p * d) + lm.lgamma(theta / d + other + t)
    weight = np.exp(log - log.max())
    mean = (weight * t).sum() / weight.sum()
    assert abs(draw(c, 1, 4000, 64).mean() - mean) < 0.3


def test_packed():
    for a in (np.arange(5, dtype=np.uint32), np.empty(0, np.uint64), np.array([1 << 63], np.uint64), np.array([0.5, -1], np.float32)):
        x, y = lm.unpacked(lm.packed(a, a[:1]))
        assert (x == a).all() and x.dtype == a.dtype and (y == a[:1]).all()
