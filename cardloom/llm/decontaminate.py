"""Benchmark decontamination with Wu-Manber multi-pattern search.

A benchmark item's windows are its runs of ``window`` consecutive words (an
item with fewer words is one window). Each window is a byte pattern of words
between single spaces, and so is each document, so plain substring search finds
exactly the word-aligned occurrences. The search keeps a shift table over
blocks of bytes: most positions are skipped; where the shift is zero, a bucket
keyed by that block names the patterns to compare directly.

Patterns reach the executors in shards of at most ``SHARD_BYTES`` bytes each,
and a document passes through the shards one after another in stages
of ``SHARDS_A_STAGE``, so memory stays bounded for any benchmark and nothing is
shuffled.

Defined cases: null text has no words and no hits; a null or wordless item has
no windows; items without an id count as hits but not as named items; items
that repeat an id count once; an empty benchmark hits nothing; columns beside
the named ones are ignored, or passed through by ``remove``; equal windows of
several items name them all; texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import trimmed, written

WINDOW = 10
SHARD_BYTES = 32 << 20
#: Shards searched in one stage, each by a worker of its own; then the state is written.
SHARDS_A_STAGE = 3
#: Patterns shorter than this are searched apart, so that they don't shorten the skips of the others.
SHORT = 24

FIGURES = ["n_words", "n_hit", "n_items", "items_sha256"]
_KEEP = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
_TABLE = bytes((ord(chr(c).lower()) if c < 0x80 else c) if c in _KEEP else 0x20 for c in range(256))


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; every byte of a non-ASCII character belongs to a word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WuManber:
    """Shift tables over blocks of ``block`` bytes of the patterns' first ``m`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        wanted = math.ceil(math.log(2 * self.m * len(patterns) + 1, 4))
        self.block = max(1, min(wanted, max(2, self.m // 2), self.m))
        self.skip = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.m + 1):
                blk = p[end - self.block : end]
                self.shift[blk] = min(self.shift.get(blk, self.skip), self.m - end)
            self.bucket[p[self.m - self.block : self.m]].append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        m, block, skip, shift, bucket = self.m, self.block, self.skip, self.shift.get, self.bucket
        end, size = m, len(text)
        while end <= size:
            blk = text[end - block : end]
            jump = shift(blk, skip)
            if jump:
                end += jump
                continue
            at = end - m
            for p in bucket[blk]:
                if text.startswith(p, at):
                    yield at, p
            end += 1


class Patterns:
    """One shard of windows, each with its word count and the items it is from."""

    def __init__(self, windows: dict[bytes, tuple[int, list[str]]]):
        self.windows = windows
        groups = [[p for p in windows if len(p) >= SHORT], [p for p in windows if len(p) < SHORT]]
        self.searches = [WuManber(g) for g in groups if g]

    def hits(self, text: bytes) -> list[tuple[int, bytes]]:
        return [h for s in self.searches for h in s.find(text)]


def windows_of(items: Iterator[tuple[str | None, str | None]], window: int) -> Iterator[tuple[bytes, int, str | None]]:
    for item, text in items:
        words = word_list(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            yield b" " + b" ".join(part) + b" ", len(part), item


def pattern_shards(benchmark: DataFrame, *, window: int, id_col: str, text_col: str, shard_bytes: int) -> Iterator[dict[bytes, tuple[int, list[str]]]]:
    """The benchmark's windows, streamed through the driver one shard at a time."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator()
    shard: dict[bytes, tuple[int, set]] = {}
    size = 0
    for pattern, n, item in windows_of(((r[0], r[1]) for r in rows), window):
        if pattern not in shard:
            size += len(pattern)
        shard.setdefault(pattern, (n, set()))[1].update([item] if item is not None else [])
        if size >= shard_bytes:
            yield {p: (n, sorted(s)) for p, (n, s) in shard.items()}
            shard, size = {}, 0
    if shard:
        yield {p: (n, sorted(s)) for p, (n, s) in shard.items()}


def _search(spark_broadcast, text_col: str, p: str):
    """A mapInArrow function that adds one shard's hits to the state columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(spark_broadcast.value)
        for b in batches:
            names = b.schema.names
            texts = b.column(names.index(text_col)).cast(pa.string()).to_pylist()
            spans = b.column(names.index(f"{p}spans")).to_pylist()
            items = b.column(names.index(f"{p}items")).to_pylist()
            for k, t in enumerate(texts):
                if not t:
                    continue
                joined = b" " + b" ".join(word_list(t)) + b" "
                found = patterns.hits(joined)
                if not found:
                    continue
                gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                first = np.searchsorted(gaps, [at for at, _ in found])
                runs = np.array([[f, f + patterns.windows[w][0]] for f, (_, w) in zip(first, found, strict=True)], dtype="<i4")
                spans[k] = (spans[k] or b"") + _merged(runs).tobytes()
                items[k] = sorted({*(items[k] or ()), *(i for w in {w for _, w in found} for i in patterns.windows[w][1])})
            arrays = list(b.columns)
            arrays[names.index(f"{p}spans")] = pa.array(spans, pa.binary())
            arrays[names.index(f"{p}items")] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _merged(runs: np.ndarray) -> np.ndarray:
    """Disjoint, sorted runs with the same union."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.r_[True, runs[1:, 0] > reach[:-1]]
    starts = np.flatnonzero(new)
    return np.stack([runs[starts, 0], reach[np.r_[starts[1:] - 1, len(runs) - 1]]], 1).astype("<i4")


def _figures(text_col: str, p: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts = b.column(names.index(text_col)).cast(pa.string()).to_pylist()
            spans = b.column(names.index(f"{p}spans")).to_pylist()
            items = b.column(names.index(f"{p}items")).to_pylist()
            hit = [0 if not s else int(np.diff(_merged(np.frombuffer(s, "<i4").reshape(-1, 2)), axis=1).sum()) for s in spans]
            sha = [hashlib.sha256(",".join(i or ()).encode()).hexdigest() for i in items]
            out = [
                *(b.column(i) for i, n in enumerate(names) if n not in (f"{p}spans", f"{p}items")),
                pa.array([len(word_list(t)) for t in texts], pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(i or ()) for i in items], pa.int64()),
                pa.array(sha, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[*(n for n in names if n not in (f"{p}spans", f"{p}items")), *(f"{p}{n}" for n in FIGURES)])

    return run


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items and items_sha256 beside its own columns, each named with ``prefix(docs)`` before."""
    sc, p = docs.sparkSession.sparkContext, prefix(docs)
    state = docs.withColumns({f"{p}spans": F.lit(None).cast("binary"), f"{p}items": F.lit(None).cast("array<string>")})
    shards = pattern_shards(benchmark, window=window, id_col=item_id_col, text_col=item_text_col, shard_bytes=shard_bytes)
    sent = []
    for k, shard in enumerate(shards):
        if k and k % SHARDS_A_STAGE == 0:
            state = written(state)
            while sent:
                sent.pop().destroy()
        sent.append(sc.broadcast(shard))
        state = state.mapInArrow(trimmed(_search(sent[-1], text_col, p)), state.schema)
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType())
    figures = T.StructType([*docs.schema.fields, *(T.StructField(f"{p}{n}", t) for n, t in zip(FIGURES, kinds, strict=True))])
    return state.mapInArrow(trimmed(_figures(text_col, p)), figures)


def prefix(docs: DataFrame) -> str:
    """Underscores with which no column of ``docs`` begins."""
    p = "__"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    return p


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    n = F.col("__n_hit")
    return matches(docs.select("doc_id", "text"), benchmark, **options).select(
        "doc_id", F.col("__n_words").alias("n_words"), n.alias("n_hit"), F.col("__n_items").alias("n_items"), F.col("__items_sha256").alias("items_sha256"), (n > 0).alias("contaminated")
    )


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, in the input's columns, whatever their names."""
    return matches(docs, benchmark, **options).where(F.col(f"{prefix(docs)}n_hit") == 0).select(*docs.columns)
