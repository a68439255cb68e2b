"""Audit of how document filters act together, whatever their order.

Each document's failed filters become one bit mask. What any order of the
filters keeps, removes, or finds removed already depends on the masks alone, so
documents are counted by part and mask once, and all orders are read off these
counts.

The filter on duplicates looks at the whole table, by partition refinement:
documents are split by their length in code points, then by the hash of a first
block, of the next, and so on (blocks grow eightfold, so long texts need few
rounds). A class left with one document is dropped at once. What survives all
blocks is compared by its full text, and all but the least id of each group of
equal texts fail.

Rows stay light: a pass over the texts writes mask, length and block hashes;
texts are read again for the last comparison only, where copies are merged
before they move. Classes that hold over a ``HOT``-th of the rows, of which there are
less than ``HOT``, are dealt over several tasks.

Defined cases: null text is empty, and equal to it; a null source is the part
''; a row without id fails no other, isn't failed as a duplicate and has no labels; rows equal
in id and text don't fail one another; each counts as a document; a document
with several labels is good, or toxic, if one of them says so, and neither
without any; an empty table yields no rows; other columns are ignored, whatever
their names; very long texts are hashed and compared whole.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE_CLASS, discard, written

#: The filters' names, in the order of their bits; the last is the one on duplicates.
NAMES = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
SYMBOLS = "[#$%&*|]"
#: Code points of the first block; each block has ``GROWTH`` times those of the one before.
BLOCK, GROWTH = 64, 8
#: Blocks so numbered cover the longest string there can be.
BLOCKS = 10
#: A class with over a HOT-th of all rows is dealt over several tasks.
HOT = 1000


def block_hashes(text: Column) -> Column:
    """Hashes of the text's blocks, none for an empty text."""
    starts = [BLOCK * (GROWTH**k - 1) // (GROWTH - 1) for k in range(BLOCKS)]
    blocks = F.array(*[F.struct(F.lit(a + 1).alias("at"), F.lit(min(BLOCK * GROWTH**k, (1 << 31) - 1)).alias("size")) for k, a in enumerate(starts) if a < 1 << 31])
    within = F.filter(blocks, lambda b: b["at"] <= F.length(text))
    return F.transform(within, lambda b: F.xxhash64(F.substr(text, b["at"], b["size"])))


def flags(docs: DataFrame) -> DataFrame:
    """Per row: id, part, the mask of the filters that look at one text alone, n (code points), blocks."""
    base = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t, s = F.col("t"), F.col("s")
    cut = base.select("id", "part", "t", F.length(t).alias("n"), F.split(t, SPACE_CLASS).alias("s"))
    # White space at an end leaves an empty string there.
    head, tail = F.get(s, F.lit(0)) == "", (F.size(s) > 1) & (F.element_at(s, -1) == "")
    sized = cut.select("id", "part", "t", "n", (F.size(s) - head.cast("int") - tail.cast("int")).alias("words"), (F.size(F.array_distinct(s)) - (head | tail).cast("int")).alias("distinct"), F.length(F.regexp_replace(t, "[^A-Z]+", "")).alias("capitals"))
    fails = [
        F.col("words") < MIN_WORDS,
        100 * F.col("distinct").cast("long") < MIN_DISTINCT * F.col("words").cast("long"),
        100 * F.col("capitals").cast("long") > MAX_CAPITALS * F.col("n").cast("long"),
        t.rlike(SYMBOLS),
    ]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return sized.select("id", "part", mask.alias("mask"), "n", block_hashes(t).alias("blocks"))


def _shared(rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` (id, ...) whose ``key`` other rows have too."""
    total = max(rows.count(), 1)
    keyed = rows.withColumn("key", key)
    counts = written(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    tasks = F.ceil(F.col("m") * HOT / total).cast("int")
    hot = counts.where(F.col("m") * HOT > total).select("key", tasks.alias("tasks"))
    dealt = keyed.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("tasks", F.lit(1))).cast("int"))
    laid = counts.select("key", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"))
    out = written(dealt.join(laid, ["key", "salt"], "left_semi").select(*rows.columns))
    discard(counts)
    return out


def refined(rows: DataFrame) -> DataFrame:
    """``rows`` (id, n, blocks, ...) that agree in length and all blocks with others, in a written table."""
    left, done, k = _shared(rows.where(F.col("id").isNotNull()), F.struct("n")), None, 0
    while left.limit(1).count():
        k += 1
        # Classes whose blocks are used up are settled.
        settled = left.where(F.size("blocks") < k)
        done = settled if done is None else done.unionByName(settled)
        left = _shared(left.where(F.size("blocks") >= k), F.struct("n", F.slice("blocks", 1, k)))
    return left if done is None else done


def duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (of ``flags``) whose text a row of smaller id has."""
    left = written(refined(rows))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").alias("id"), text.alias("t")).join(left.select("id").distinct(), "id", "left_semi")
    first = texts.groupBy("t").agg(F.min("id").alias("id")).select("id", F.length("t").alias("n"), block_hashes(F.col("t")).alias("blocks"))
    return written(left.join(first, ["id", "n", "blocks"], "left_anti"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask: documents n, those labelled good, those labelled toxic."""
    rows = written(flags(docs))
    again = duplicates(docs, rows)
    one = lambda df, mask, w: df.select("id", "part", mask.alias("mask"), F.lit(w).cast("long").alias("w"))
    mask = F.col("mask")
    moved = one(rows, mask, 1).unionByName(one(again, mask, -1)).unionByName(one(again, mask + (1 << (len(NAMES) - 1)), 1))
    has = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    told = labels.groupBy(F.col("doc_id").alias("id")).agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    both = moved.join(told, "id", "left")
    sums = {"n": F.sum("w"), "good": F.sum(F.col("w") * F.coalesce("good", F.lit(0))), "toxic": F.sum(F.col("w") * F.coalesce("toxic", F.lit(0)))}
    return both.groupBy("part", "mask").agg(*[c.alias(k) for k, c in sums.items()])


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """Every order of the filters, step by step, from ``counts`` (part, mask, n, good, toxic)."""
    orders = ",".join(map("".join, itertools.permutations(names)))
    placed = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    at = [F.instr(F.col("filter_order"), c) for c in names]
    bit = sum(((p == F.col("step")).cast("int") * (1 << k) for k, p in enumerate(at)), F.lit(0))
    before = sum(((p < F.col("step")).cast("int") * (1 << k) for k, p in enumerate(at)), F.lit(0))
    here, alive, only = F.col("mask").bitwiseAND(bit) > 0, F.col("mask").bitwiseAND(before) == 0, F.col("mask") == bit
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    # Of a document's failed filters each comes first in an equal share of the orders.
    share = F.expr(f"n * (CAST({math.factorial(len(names))} AS BIGINT) div greatest(bit_count(mask), 1))")
    return placed.withColumn("share", share).groupBy("part", "filter_order", "step").agg(
        total(alive & ~here).alias("kept"),
        total(alive & here).alias("removed"),
        total(~alive & here).alias("redundant"),
        total(only).alias("unique_fails"),
        total(alive & here, "good").alias("good_lost"),
        total(alive & here, "toxic").alias("toxic_lost"),
        total(here, "share").alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(masks(docs, labels))
