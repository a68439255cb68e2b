"""Operators 4, 5 and 9 against brute force and exact round trips."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardloom.llm import decontaminate, packing, tokenfiles, tokens

TEXTS = [
    (1, "Hello  world. It's  odd\n\nspacing\t here ", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (3, "same id, other text", "x"),
    (3, "same id, other text", "x"),
    (None, "no id ümläut 日本語。 😀  nbsp <|endoftext|>", "x"),
    (9, "word. " * 9000, "x"),
    (10, "longpiece" * 40 + " \x00nul \x1cfs x", "x"),
    (11, "x" * 5000, "x"),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "'' part")
    return spark.createDataFrame(TEXTS, "doc_id long, text string, part string").unionByName(real).repartition(3).cache()


@pytest.mark.parametrize("specials", [False, True])
@pytest.mark.parametrize("name,lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(docs, name, lead, specials):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = not specials
    enc = tokens.Encoder(path, lead=lead, specials=specials)
    for r in docs.collect() * 2:
        assert enc.ids(r.text or "").tolist() == plain.encode(r.text or "", add_special_tokens=False).ids


# White space beside white space, the separator, marks after a space, specials' strings.
ODD = ["", None, " ", "a", " a", "a ", "a  b", "a\nb c", "a \nb", "a\n b c", "x\x01 y \x01 z", "\u3000 x", "it's 's 'll", "e \u0301 x Σ", "a\xa0b \xa0d", "<|endoftext|> x <|startoftext|>", "hello <|endoftext|> there", "a<|endoftext|>b c <|ENDOFTEXT|> d", " <|startoftext|>", "中文 字 。", "a\x85b \x1c c", "x" * 100 + " y", "a İ&&& b.c! x\x02y z\x02&", "don't... l'été##\nÜber.\n\nab", "e&\u0301 a<\u0338 ß%%% 1$2"]


@pytest.mark.parametrize("specials", [False, True])
@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
@pytest.mark.parametrize("name,lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_odd_texts(monkeypatch, name, lead, chunk, specials):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(tokens, "CACHE_PARTS", 20)
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = not specials
    enc = tokens.Encoder(path, lead=lead, specials=specials)
    got = [i.tolist() for i in enc.batch(pa.array(ODD * 2))]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in ODD * 2]


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path).collect()
    enc = tokens.Encoder(path, lead=False)
    want = Counter((r.doc_id, len(enc.ids(r.text or "")) + 1) for r in docs.collect())
    by_seq = defaultdict(list)
    tokens_of = Counter()
    for r in got:
        by_seq[r.sequence_id].append(r)
        tokens_of[r.doc_id, r.doc_tokens] += r.length
    assert tokens_of == Counter({k: k[1] * n for k, n in want.items()})
    assert sorted(by_seq) == list(range(len(by_seq)))
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.006 * sum(tokens_of.values())
    one = next(r for r in docs.collect() if r.doc_id == 9)
    ids = np.r_[enc.ids(one.text), 1].astype("<u4")
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got if r.doc_id == 9)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_optimum():
    rng = np.random.default_rng(5)
    for _ in range(20):
        gaps = rng.integers(1, 6, 30)
        pos, cost = np.cumsum(gaps), rng.choice([0.0, 3.0, 9.0], 30)
        cuts = packing.best_cuts(pos, cost, 16)
        best = {0: 0.0}
        for p, c in zip(pos, cost, strict=True):
            best[p] = min(v + 16 - (p - q) + c for q, v in best.items() if p - q <= 16)
        at = dict(zip(pos, cost, strict=True))
        assert pos[-1] - cuts[-1] <= 16
        assert sum(16 - (b - a) + at[b] for a, b in zip([0, *cuts], cuts)) == min(v for q, v in best.items() if pos[-1] - q <= 16)


def test_token_files(docs, spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokenfiles.report(docs, path).orderBy("start").collect()
    enc = tokens.Encoder(path, lead=True)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.r_[enc.ids(r.text or ""), 0].astype("<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfiles.report(docs.limit(0), path).count() == 0


def test_random_access(tmp_path):
    import pyarrow as pa

    ids = np.arange(10_000, dtype="<u2")
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f:
        w = tokenfiles.SequenceWriter(f, ids.dtype, 64, 8)
        for part in np.array_split(ids, 37):
            w.add(part)
        w.close()
    with pa.memory_map(str(tmp_path / "x.arrow")) as f:
        before = pa.total_allocated_bytes()
        r = tokenfiles.SequenceReader(f)
        seq, mask = r.sequence(100)
        assert seq.tolist() == list(range(6400, 6464)) and all(mask.to_pylist())
        assert pa.total_allocated_bytes() - before < 4096  # no copy of the ids
        seq, mask = r.sequence(156)
        assert mask.to_pylist() == [k < 10_000 - 156 * 64 for k in range(64)]
        assert r.ids(500, 5000).tolist() == list(range(500, 5500))


ITEMS = [("1", "Alpha, beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), ("2", "tiny one"), ("3", None), (None, "q w e r"), ("2", "a b c d e f g h i j k"), ("10", "b c d e f g h i j k l")]


def test_decontaminate(spark, sf_dir):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string").unionByName(spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("cast(item_id + 100 as string) item_id", "text"))
    docs = spark.createDataFrame(
        [(1, "x beta-gamma DELTA epsilon zeta eta theta iota kappa lambda mu, a tiny, one q w e r", 5), (2, None, 5), (3, "", 5), (4, "tiny ones a b c d e f g h i j k l", 5), (4, "a b c d e f g h i j", 5), (None, "müß tiny one", 5)],
        "doc_id long, text string, __n int",
    ).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "5 __n"))
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = defaultdict(set)
    for r in bench.collect():
        w = pat.findall(low(r.text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(r.item_id)
    sizes = {len(w) for w in windows}
    want = Counter()
    for r in docs.collect():
        w = pat.findall(low(r.text))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[k]
        items -= {None}
        want[(r.doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    for shard in (1 << 20, 15_000):
        assert Counter(map(tuple, decontaminate.report(docs, bench, shard_bytes=shard).collect())) == want
    kept = decontaminate.remove(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    clash = docs.selectExpr("*", "'a' __spans", "'b' __items", "'c' __n_hit", "'d' ___n_words")
    assert set(map(tuple, decontaminate.remove(clash, bench).drop("doc_id", "text", "__n").collect())) == {("a", "b", "c", "d")}
    many = spark.createDataFrame([(1, "word " * 200_000 + "tiny one"), (2, "tiny one " * 50_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.report(many, bench).collect()) == [(1, 200_002, 2), (2, 100_000, 100_000)]
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0
