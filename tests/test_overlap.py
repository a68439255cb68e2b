"""Similar sets found by their rare terms, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import overlap, similarity
from cardloom.sources.scratch import written


def _rows(spark, sets, first=0):
    rows = [(first + i, first + i, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, ord long, words array<string>")
    return written(df.select("key", "ord", F.transform("words", lambda x: F.xxhash64(x)).alias("set")))


def _made(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    sets = [set(rng.sample(words, rng.choice((1, 2, 3, 10, 20, 300))) if k % 2 else rng.sample(words[:20], rng.randint(4, 18))) for k in range(60)]
    for _ in range(60):
        near = set(rng.choice(sets))
        for _ in range(rng.randint(0, 1 + len(near) // 4)):
            near.discard(rng.choice(sorted(near))) if len(near) > 1 and rng.random() < 0.5 else near.add(rng.choice(words))
        sets.append(near)
    return [set(x) for x in dict.fromkeys(tuple(sorted(s)) for s in sets)]


def _close(a, b, t):
    return len(a & b) >= t * len(a | b) - 1e-9


@pytest.mark.parametrize("chunk", [97, 1 << 19])
def test_all_pairs_and_few_others(spark, monkeypatch, chunk):
    monkeypatch.setattr(overlap, "CHUNK", chunk)
    sets = _made(3)
    rows = _rows(spark, sets)
    for t in (0.6, 0.85):
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and _close(a, b, t)}
        found = similarity.pairs(rows, t).collect()
        assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
        assert all(r.common == len(sets[r.a] & sets[r.b]) for r in found)
    one, other = sets[:40], sets[40:]
    got = {(r.x, r.y) for r in overlap.candidates(_rows(spark, one), 0.6, _rows(spark, other, 1000)).collect()}
    assert {(i, 1000 + j) for i, a in enumerate(one) for j, b in enumerate(other) if _close(a, b, 0.6)} <= got


def test_a_shared_rare_term_alone_makes_no_row(spark):
    """500 sets that all share their rarest term: 124,750 pairs of which one is similar."""
    sets = [{"rarest", *(f"t{k}" for k in random.Random(i).sample(range(3000), 60))} for i in range(499)]
    sets.append(sets[0] | {"more"})
    rows = _rows(spark, sets)
    assert [tuple(sorted((r.x, r.y))) for r in overlap.candidates(rows, 0.6).collect()] == [(0, 499)]
