"""Operators 1, 2 and 10 against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cardloom.llm import quality, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, shard string"
HEX = "0123456789abcdef" * 3
ROWS = [
    (1, 'x token = "' + HEX[:40] + '" é😀 secret: short', "en", "a", 1, "r", "s"),
    (2, 'x token = "' + HEX[:40] + '" copied PASSWORD=token: abcdefghij', "en", "b", 1, "r", "s"),
    (3, "AKIA" + "Z" * 12 + " AKIAshort Bearer abcdefghijklmnopqrstuvwxyz.1", None, None, None, None, None),
    (3, "AKIA" + "Z" * 12 + " AKIAshort Bearer abcdefghijklmnopqrstuvwxyz.1", None, None, None, None, None),
    (4, None, "en", "a", 1, None, None),
    (5, "", "en", "a", 1, None, None),
    (None, "the a b the a b the a b c\n\nHome | About | Login\n" + "word " * 60 + ".", "en", "a", 1, None, None),
    (7, "Line one is fine.\nLine one is fine.\n \n" + " ".join(f"w{i}" for i in range(80)) + ".", "en", "a", 1, None, None),
    (8, (HEX[:32] + " ") * 300, "en", "c", 1, None, None),
    (9, "\x85\nx\n\x85\n\u2028\n\u2029\n\u2028\n \r\n \r", "en", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars", "'' row", "'' shard")
    return spark.createDataFrame(ROWS, SCHEMA).unionByName(real).cache()


def base_spans(t):
    out = []
    for rank, (kind, pat, group, least) in enumerate(
        [
            ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 16),
            ("hex", r"[0-9a-f]+", 0, 32),
        ]
    ):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pat, t) if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets(docs):
    got = secrets.report(docs).collect()
    want = Counter()
    for r in docs.collect():
        s = base_spans(r.text or "")
        n = Counter(x[2] for x in s)
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        want[(r.doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert "bearer" in by[3].spans and by[3].n_live == 2  # one owner, two rows
    assert by[1].n_example >= 1 and by[4].spans == ""
    assert secrets.report(docs.limit(0)).count() == 0


def repeated(w):
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    return len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)})


def test_quality(docs):
    got = Counter(tuple(r)[:7] for r in quality.report(docs).collect())
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = repeated(w)
        want[(r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w))] += 1
    assert got == want
    assert quality.report(docs.limit(0)).count() == 0


def test_quality_lines(spark):
    good = " ".join(f"word{i}" for i in range(70)) + "."
    rows = [(1, good + "\nHome | About | Contact\nAll rights reserved.\n"), (2, " ".join(f"word{i} ###" for i in range(70))), (3, good)]
    out = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: good + "\n", 3: good}


def test_quality_line_ends(spark):
    rows = [(1, "\x85\n\x85"), (2, "\u2028\nx\n\u2028\n\u2028"), (3, " \t\n \t\n\r\n\r"), (4, "end.\u2029\nHome | About\x85")]
    out = {r.doc_id: (r.n_dup_lines, r.n_lines_removed) for r in quality.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (1, 2), 2: (2, 4), 3: (0, 0), 4: (0, 2)}


def test_sharding(docs, spark):
    hot = spark.createDataFrame([(i, "copy " * 50) for i in range(10_000, 11_000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(hot)
    got = sharding.report(both, 8).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in both.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    slots = defaultdict(list)
    sums = Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    big = max(r["size"] for r in got)
    mean = sum(sums.values()) / 8
    assert max(sums.values()) <= mean + 2 * big
    order = [r.key for r in sorted(sharding.assign(both, 8).collect(), key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.report(both.limit(0), 8).count() == 0
    assert {r.shard for r in sharding.report(both.limit(2), 40).collect()} <= set(range(40))


def test_write_shards(docs, spark, tmp_path):
    sharding.write_shards(docs.drop("shard"), f"file://{tmp_path}/out", 4)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == docs.count()


def test_menus(spark):
    """Lines of menu entries go, also with a full stop and very long ones; a sentence that starts like one stays."""
    fill = "\n" + " ".join(f"w{i}" for i in range(200)) + "."
    lines = ["Home | About us | Sign in.", "log in sign up", "Sign up.", "Home is where we are.", "home " * 100_000 + ".", "house " * 100_000 + ".", "home · " * 100_000 + "house."]
    docs = spark.createDataFrame([(i, x + fill) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_lines_removed for r in quality.report(docs).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0}
