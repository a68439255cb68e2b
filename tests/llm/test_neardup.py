"""Operator 3 against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from cardloom.llm import graph, neardup


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    """Component ids by all pairs that share a shingle."""
    sets = {}
    for k, (_, t) in enumerate(rows):
        sets.setdefault(shingles(t), []).append(k)
    reps = [s for s in sets if s]
    parent = list(range(len(reps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inv = {}
    for k, s in enumerate(reps):
        for g in s:
            inv.setdefault(g, []).append(k)
    common = Counter()
    for ks in inv.values():
        for a in range(len(ks)):
            for b in range(a + 1, len(ks)):
                common[ks[a], ks[b]] += 1
    for (a, b), c in common.items():
        if 100 * c >= 85 * (len(reps[a]) + len(reps[b]) - c):
            parent[find(a)] = find(b)
    least = {}
    for k, s in enumerate(reps):
        ids = [rows[r][0] for r in sets[s] if rows[r][0] is not None]
        least.setdefault(find(k), []).extend(ids)
    comp = {s: min(least[find(k)], default=None) for k, s in enumerate(reps)}
    return Counter((d, len(s := shingles(t)), comp[s] if s else d, d == (comp[s] if s else d)) for d, t in rows)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(150)]
    near = []
    for k in range(140):  # one base text, edited a little to a lot
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        near.append((20_000 + k, " ".join(w)))
    odd = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (4, "one two"), (None, "one\ttwo"), (5, " \n"), (6, "É one two"), (6, "É one two"), (7, "é one two"), (8, "a b c d " * 4000)]
    return odd + near + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_components(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' component", "1 n").repartition(3)
    assert Counter(map(tuple, neardup.report(docs).collect())) == brute(rows)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "LARGE", 8)
    assert Counter(map(tuple, neardup.report(docs).collect())) == brute(rows)
    kept = neardup.deduplicate(docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns
    want = {d for d, _, c, _ in brute(rows) if d == c}
    assert set(ids) - {None} == want and ids[6] == 1
    assert neardup.report(docs.limit(0)).count() == 0


def test_sequential_bounds():
    rng = np.random.default_rng(2)
    steps = neardup.least_matches()
    for s, expect in ((0.85, 1.0), (0.3, 0.0)):
        same = rng.random((4000, neardup.HASHES)) < s
        alive = np.ones(4000, bool)
        for m, least in steps:
            alive &= same[:, :m].sum(1) >= least
        assert abs(alive.mean() - expect) < 0.002


def test_graph(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 300)] + [(50, 100)]
    got = {r.v: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {v for k, v in got.items() if k >= 50} == {50}


def test_five_words(spark):
    """A copy with 20 words appended is near by five words at 0.8, not by three at 0.85; with 30 it isn't near."""
    text = " ".join(f"w{k}" for k in range(100))
    other = text.replace("w", "v")
    more = lambda t, n: " ".join([t, *(f"x{k}" for k in range(n))])
    docs = spark.createDataFrame([(1, text), (2, more(text, 20)), (3, other), (4, more(other, 30))], "doc_id long, text string")
    assert {r.doc_id for r in neardup.deduplicate(docs, neardup.FIVE_WORDS).collect()} == {1, 3, 4}
    assert {r.doc_id for r in neardup.deduplicate(docs).collect()} == {1, 2, 3, 4}


def test_hubs(spark, rows, monkeypatch):
    """Hub links hold, reach most members of large bands, and change no component."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rounds, size in ((0, 16), (1, 4), (3, 4)):
        monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
        monkeypatch.setattr(neardup, "HUB_ROWS", size)
        monkeypatch.setattr(neardup, "LARGE", 4)
        monkeypatch.setattr(neardup, "BLOCK", 8)
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
        assert Counter(map(tuple, neardup.report(docs).collect())) == brute(rows)


def test_clashing_names_and_other_ids(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([("b", text, 1, "x", 5), ("a", text, 2, "y", 6), ("a", text, 2, "y", 6), (None, text, 3, "z", 7), ("c", None, 4, "t", 8)], "doc_id string, text string, __h int, _0 string, __id int")
    assert sorted(map(tuple, neardup.deduplicate(docs).collect())) == [("a", text, 2, "y", 6), ("c", None, 4, "t", 8)]


def test_words_of_many_texts():
    import pyarrow as pa

    texts = ["Ab\tc  D\x85e", None, "", " \x0b\x0c", "\x1cx y\x00z", "é É", "a" * 300 + " b"]
    for size in (1, 8, 1 << 20):
        got = [s.tolist() for c in neardup.chunks_of(pa.array(texts), size) for w, at in [neardup.batch_words(c)] for s in (w[a:b] for a, b in zip(at, at[1:]))]
        assert got == [neardup.word_hashes(t).tolist() for t in texts]
