"""The filter audit against brute force: duplicates by refinement, orders step by step."""

import itertools
import random
import re

import pytest

from cardloom.llm import filters

SCHEMA = "doc_id long, text string, source string, n int, blocks int, mask int, t string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(rows, labels):
    least, docs = {}, []
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for i, text, source in rows:
        f = fails(text or "") | {"E": i is not None and i > least[text or ""]}
        docs.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                kept = [d for d in left if c not in d[1]]
                every = [d for d in mine if c in d[1]]
                out[part, "".join(order), step] = [len(kept), len(gone), len(every) - len(gone), sum(d[1] == {c} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[c] += len(gone)
                left = kept
        for order in itertools.permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[c])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.choice([3, 60, 700]))) for _ in range(12)]
    # Same length, same first blocks, another tail; and the reverse.
    texts += [texts[0][:-1] + "#", "A" + texts[1][1:], ("x" * 5000) + "a", ("x" * 5000) + "b", ("x" * 700) + "a" + "x" * 4300, "W" * 64, "W" * 65, None, "", " \t", "\x0b one\x0b"]
    out = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(90)]
    out += [(i, "copied text " * 30, "a") for i in range(1000, 1060)]
    return out + [(7, "twice", "a"), (7, "twice", "a"), (None, "twice", "b"), (None, "no id", "b"), (None, "no id", "b"), (8, "twice", "b")]


def test_brute_force(spark, rows):
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 1050, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (5000, 1, 1)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    # Columns named like those of the audit change nothing.
    docs = spark.createDataFrame([(i, t, s, 1, 2, 3, "x") for i, t, s in rows], SCHEMA)
    got = filters.report(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    want = brute(rows, labels)
    assert len(got) == len(found) == len(want)
    assert found == want


def test_equal_hashes(spark, rows, monkeypatch):
    """Texts whose blocks all agree are told apart by themselves."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(filters, "block_hashes", lambda t: F.array(F.lit(1).cast("long")))
    docs = spark.createDataFrame([(i, t, s, 1, 2, 3, "x") for i, t, s in rows if i is not None], SCHEMA).dropDuplicates(["doc_id"])
    kept = {r.doc_id: r.text or "" for r in docs.collect()}
    again = {r.id for r in filters.duplicates(docs, filters.flags(docs)).collect()}
    least = {}
    for i in sorted(kept):
        least.setdefault(kept[i], i)
    # Only a row whose text is another's in the same class of length may be marked; equal lengths share one hash here.
    assert again == {i for i, t in kept.items() if least[t] != i}


def test_hot_class(spark, monkeypatch):
    """A class dealt over several tasks is found whole."""
    monkeypatch.setattr(filters, "HOT", 4)
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"text {i:04d}", "a") for i in range(300)], "doc_id long, text string, source string")
    assert {r.id for r in filters.duplicates(docs, filters.flags(docs)).collect()} == {i for i in range(2, 300) if i % 3}


def test_empty_and_long(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.report(spark.createDataFrame([], "doc_id long, text string, source string"), labels).count() == 0
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long + "a", "s"), (2, long + "a", "s"), (3, long + "b", "s")], "doc_id long, text string, source string")
    assert [r.id for r in filters.duplicates(docs, filters.flags(docs)).collect()] == [2]
