"""Sharding by histogram sort (DataFrame functions only).

The sort key is a 63-bit number: the high bits are a hash of the text, so equal
texts lie together, the low bits a hash of the id, so a group of copies that
holds a third of all rows can be cut anywhere. Exact bytes are counted below
evenly placed probes; each round refines only the cells in which a wanted
boundary lies, until every boundary meets the tolerance. Then rows move once,
and slots follow the key: a shard is sorted in pieces, ranges of the key with
about equal numbers of rows, found by the same histograms.

Defined cases: null text has no bytes; a null id hashes as such; rows equal in
id and text share a key and stay together, so only these can make shards
uneven; fewer rows than shards leave shards empty; other columns are ignored
by ``report`` and kept by ``assign``.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written

ROW_OVERHEAD = 16
TEXT_BITS, ID_BITS = 39, 24
KEY_BITS = TEXT_BITS + ID_BITS
#: Cells of the first histogram and of each refined cell, as powers of two.
FIRST_BITS, STEP_BITS = 12, 9
#: A boundary may be off by this part of a shard.
TOLERANCE = 0.001
#: The whole table is sorted in so many pieces; a piece may be off by this part at either end.
PIECES, PIECE_TOLERANCE = 1024, 0.5


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def sort_key(doc_id: Column, text: Column) -> Column:
    high = F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit((1 << TEXT_BITS) - 1)), ID_BITS)
    return high.bitwiseOR(F.xxhash64(doc_id, F.lit(7)).bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE, weight: str = "size") -> list[int]:
    """``shards - 1`` keys; shard k takes keys from splitter k-1 up to below splitter k.

    Shards are of equal sums of the column ``weight``.

    Each round is one aggregation whose result has at most
    ``shards * 2**STEP_BITS`` rows (``2**FIRST_BITS`` in the first), whatever
    the size of the table.
    """
    shift = KEY_BITS - FIRST_BITS
    cells = dict(keyed.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum(weight)).collect())
    total = sum(cells.values())
    targets = [total * (k + 1) / shards for k in range(shards - 1)]
    done: dict[int, int] = {}
    open_cells: dict[int, tuple[int, list[int]]] = {}

    def place(groups: list[tuple[int, int, dict[int, int], list[int]]], shift: int, parent_shift: int) -> None:
        """Settle targets on edges of these cells, or leave the cell to refine."""
        open_cells.clear()
        for first, before, counts, wanted in groups:
            order = sorted(counts)
            i, below = 0, before
            for k in wanted:
                while i < len(order) and below + counts[order[i]] <= targets[k]:
                    below += counts[order[i]]
                    i += 1
                if i == len(order):
                    done[k] = (first + 1) << parent_shift if order else 0
                    continue
                low, high = targets[k] - below, below + counts[order[i]] - targets[k]
                if min(low, high) <= tolerance * total / shards or shift == 0:
                    done[k] = (order[i] + (high < low)) << shift
                else:
                    open_cells.setdefault(order[i], (below, []))[1].append(k)

    place([(0, 0, cells, list(range(shards - 1)))], shift, KEY_BITS)
    while open_cells:
        step = min(STEP_BITS, shift)
        parents = dict(open_cells)
        # Parents are at most shards - 1 literals, so the filter stays inside the scan's stage.
        rows = (
            keyed.where(F.shiftright("key", shift).isin(list(parents)))
            .groupBy(F.shiftright("key", shift - step).alias("cell"))
            .agg(F.sum(weight).alias("s"))
            .collect()
        )
        counts: dict[int, dict[int, int]] = {p: {} for p in parents}
        for cell, s in rows:
            counts[cell >> step][cell] = s
        shift -= step
        place([(p, before, counts[p], wanted) for p, (before, wanted) in parents.items()], shift, shift + step)
    out, last = [], 0
    for k in range(shards - 1):
        last = max(last, done.get(k, 0))
        out.append(last)
    return out


def _place(key: Column, cuts: list[int], inner: list[int]) -> tuple[Column, Column]:
    """The shard of a key, and its piece there; pieces are cut at ``inner``."""

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda c: c <= key)).cast("int")

    def longs(cs: list[int]) -> Column:
        return F.array(*[F.lit(c) for c in cs]).cast("array<bigint>")

    edges = [0, *cuts, 1 << KEY_BITS]
    shard = below(longs(cuts))
    pieces = F.array(*[longs(sorted({c for c in inner if low < c < high})) for low, high in pairwise(edges)])
    return shard, below(F.get(pieces, shard))


def assign(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, pieces: int = PIECES) -> DataFrame:
    """Per document: id, size, key, shard and slot (gapless from 0 in its shard, in order of the key)."""
    keyed = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            text_bytes(F.col(text_col)).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            sort_key(F.col(id_col), F.col(text_col)).alias("key"),
        )
    )
    # Shards are even in bytes, pieces in rows, since it is rows that are sorted here.
    inner = splitters(keyed.select("key", F.lit(1).alias("row")), pieces, PIECE_TOLERANCE, "row")
    shard, piece = _place(F.col("key"), splitters(keyed, shards, tolerance), inner)
    placed = keyed.withColumn("shard", shard).withColumn("piece", piece)
    # shards + pieces counts at most: where each piece's slots begin.
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("shard", "piece").orderBy("key", "doc_id")
    return (
        placed.withColumn("n", F.row_number().over(within) - 1)
        .join(F.broadcast(begins), ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("begin") + F.col("n")).cast("long").alias("slot"))
    )


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, *, tolerance: float = TOLERANCE, pieces: int = PIECES) -> None:
    """Documents, whole rows, into ``path/shard=N``; rows move in one exchange, each file lies in order of the key.

    Beside the folder's own column ``shard``, the input must have none of that name.
    """
    keyed = written(docs.select(text_bytes(F.col("text")).alias("size"), sort_key(F.col("doc_id"), F.col("text")).alias("key")))
    shard, piece = _place(sort_key(F.col("doc_id"), F.col("text")), splitters(keyed, shards, tolerance), splitters(keyed, pieces, PIECE_TOLERANCE))
    moved = docs.withColumn("shard", shard).repartition("shard", piece)
    moved.sortWithinPartitions("shard", sort_key(F.col("doc_id"), F.col("text"))).write.partitionBy("shard").parquet(path)
