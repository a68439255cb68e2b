"""Operator 6 against brute force and held-out accuracy."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from cardloom.llm import pii

ROWS = [
    (1, "mail a.b@x-y.co.uk, +1 (743) 555-3824 and 4785 3805-9239 1139 1.2.3.4 999.1.1.1", 1),
    (2, None, 1),
    (3, "", 1),
    (3, "4111111111111111 4111111111111112 @ a@b +12 1.2.3", 1),
    (None, "😀 call me at 555-123-4567, ssn 123-45-6789, joe (at) example (dot) org", 1),
    (5, "plain 2024-01-02 and 123 456 items at home. total 100 200 3000", 1),
    (6, "a@b.c@d.e 00001.2.3.4.5.6.7.8 +" + "1" * 30, 1),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.createDataFrame(ROWS, "doc_id long, text string, spans int").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 100 doc_id", "text", "1 spans"))


def brute(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    n = lambda s: re.sub(r"[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(n(s)) <= 19 and luhn(n(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(n(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m.group())]


def test_base(docs):
    want = Counter()
    for r in docs.collect():
        s = brute(r.text or "")
        c = Counter(x[0] for x in s)
        want[(r.doc_id, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    got = pii.report(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    by = {r.doc_id: r.spans for r in got}
    assert by[5] == "" and all(k in by[None] for k in ("localphone", "idnumber", "spelled"))
    assert pii.report(docs.limit(0)).count() == 0


def test_redact(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[2] is None and by[5] == ROWS[5][1] and by[1].startswith("mail [EMAIL], [PHONE] and ")
    assert not any(brute(t or "") for k, t in by.items() if k != 6)


def test_held_out():
    trees, limits = pii.model()
    rng = random.Random(99)
    rows = [pii._example(rng) for _ in range(1500)]
    p = trees.probability(np.array([pii.features(*r[:4]) for r in rows]))
    picked = np.array([q >= limits[r[1]] for q, r in zip(p, rows, strict=True)])
    y = np.array([bool(r[4]) for r in rows])
    assert (picked & y).sum() / picked.sum() > 0.97 and (picked & y).sum() / y.sum() > 0.9


# Texts that no template has written: what is personal in each, or nothing.
PERSONAL = [
    ("415.555.2671 is the number to text", "415.555.2671"),
    ("123-45-6789 is my social", "123-45-6789"),
    ("you can ring (212) 555-0187 after six", "(212) 555-0187"),
    ("Her cell: 646-555-0143, leave a message", "646-555-0143"),
    ("john dot smith (at) gmail (dot) com", "john dot smith (at) gmail (dot) com"),
    ("write to anna [at] posteo [dot] de please", "anna [at] posteo [dot] de"),
    ("iban DE89 3704 0044 0532 0130 00 for the rent", "DE89 3704 0044 0532 0130 00"),
    ("My SSN? 219-09-9999, do not share it", "219-09-9999"),
    ("503-555-0199 rings at my desk", "503-555-0199"),
    ("We moved, so 617.555.0123 no longer works for me", "617.555.0123"),
    ("mary.jones at example dot org is best", "mary.jones at example dot org"),
    ("Dad's passport and 078-05-1120 were in the bag", "078-05-1120"),
    ("fax the form to 312-555-0100 today", "312-555-0100"),
    ("Pay into GB82 WEST 1234 5698 7654 32 by Friday", "GB82 WEST 1234 5698 7654 32"),
    ("the plumber, (503) 555-0142, was great", "(503) 555-0142"),
    ("send it to bob(at)corp.io", "bob(at)corp.io"),
    ("call the clinic on 020 7946 0958", "020 7946 0958"),
    ("If lost, phone 0161 496 0000", "0161 496 0000"),
]
PLAIN = [
    "order 415 555 2671 shipped", "part 123-45-6789 is out of stock", "total 100 200 3000", "we met at home.then left", "plain 2024-01-02 and 123 456 items at home", "invoice 212-555-0187 was paid",
    "the score was 110-95-2024 points in all", "look at example.page for more", "version 10.20.3000 is out", "in 1999 2000 2001 we sold 300 400 5000 units", "serial AB12 3456 7890 1234 5678", "ISBN 978-3-16-148410-0",
]


def test_other_texts():
    trees, limits = pii.model()
    found = [[t[a:b] for _, a, b in pii.find(t, trees, limits)] for t, _ in PERSONAL]
    assert sum(want in got for got, (_, want) in zip(found, PERSONAL, strict=True)) >= 0.9 * len(PERSONAL)
    assert sum(bool(pii.find(t, trees, limits)) for t in PLAIN) <= 1


def test_base_of_random_texts():
    """The scans that start inside a match against the patterns as they are stated."""
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice("aB1.@-+% 0é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == [(("email", "ip", "card", "phone").index(k), a, b) for k, a, b in brute(t)], t


def test_long_runs():
    """Time grows with the text, not with its square."""
    import time

    trees, limits = pii.model()
    n = 400_000
    for t in ("a" * n + " at b", "a" * n + "@", "1" * n + ".2.3 @", "@a." * n, "a@b.c@" * (n // 6), "x at y " * (n // 7) + "(" * n, "5" * n, "+1" * n, "1.2.3.4." * (n // 8), " at " * n, "a dot " * (n // 6) + "b at c.d"):
        began = time.monotonic()
        pii.find(t, trees, limits)
        assert time.monotonic() - began < 20, t[:20]
