"""What a task of the similarity joins holds, and that dealing in many parts and blocks loses no pair."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import overlap, similarity
from cardloom.sources import scratch
from test_overlap import _close, _made, _rows


def test_bitmaps_are_compared_in_bounded_memory():
    """100,000 pairs of two bitmaps of 8 KB: 2.4 GB if all were taken at once."""
    n = np.array([30_000, 40_000])
    bits = overlap._Bitmaps()
    bits.add(n, np.random.default_rng(1).bytes(2 * 8192))
    bits.close(n)
    pairs = np.zeros(100_000, dtype=np.int64)
    tracemalloc.start()
    found = bits.differ(pairs, pairs + 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found.tolist())) == 1 and found[0] > 0 and peak < 200_000_000


@pytest.mark.parametrize("small", [False, True])
def test_parts_and_blocks_lose_no_pair(spark, monkeypatch, small):
    if small:
        for module, name, value in ((overlap, "BYTES", 500), (overlap, "SLICE", 200), (overlap, "TERMS", 150), (overlap, "HELD", 5), (overlap, "WORDS", 100), (similarity, "FAMILY", 3), (similarity, "MEMBERS", 10), (similarity, "PAIRS", 10)):
            monkeypatch.setattr(module, name, value)
    sets = _made(5)
    family = {f"f{k}" for k in range(40)}
    sets += [family | {f"own{k}"} for k in range(30)]
    rows = _rows(spark, sets)
    assert (overlap._parts(0.6, rows) > overlap.TASKS) == small
    want = {(i, j): len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and _close(a, b, 0.6)}
    found = similarity.pairs(rows, 0.6).collect()
    assert {(r.a, r.b): r.common for r in found} == want and len(found) == len(want)
    one, other = sets[::2], sets[1::2]
    held = similarity.held_against(_rows(spark, one), _rows(spark, other, 1000), 0.6).collect()
    assert {(r.b, r.a - 1000) for r in held} == {(i, j) for i, a in enumerate(one) for j, b in enumerate(other) if _close(a, b, 0.6) and b not in other[:j]}


def test_a_set_is_sent_once_for_all_pairs_of_its_family(spark):
    """40 sets that are all similar: 780 pairs, for which each set was sent 20 times."""
    rows = _rows(spark, [{f"f{k}" for k in range(60)} | {f"own{i}"} for i in range(40)])
    near = scratch.written(overlap.candidates(rows, 0.6))
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/cardloom"
    before = set(os.listdir(root))
    assert near.count() == 780 and similarity._full(near, rows, rows).count() == 780
    tables = [spark.read.parquet(f"file://{root}/{x}") for x in set(os.listdir(root)) - before]
    assert sum(t.count() for t in tables if t.columns == ["bucket", "role", "key"]) == 78


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with scratch.writing(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
    assert scratch.written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()).count() == 3
