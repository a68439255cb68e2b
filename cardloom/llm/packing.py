"""Order-preserving packing by dynamic programming with a monotone queue.

Each input partition is packed in its stored order. Nodes are the places where
a sequence may end: document ends (no penalty), sentence ends (a small one) and,
where neither comes for long, plain token places (a larger one). With f(j) the
least cost of the tokens before node j,

    f(j) = min over i with pos(j) - pos(i) <= capacity of
           f(i) + (capacity - (pos(j) - pos(i))) + penalty(j)

and as the padding is linear in pos(i), the minimum slides over f(i) + pos(i):
a monotone queue makes each step constant. Work goes in blocks of tokens, the
open end of a block starting the next one, so memory stays bounded. What is
left at a partition's end is split into powers of two, which need no padding.

Defined cases: null or empty text has the end token alone; repeated rows and
null ids are packed like any others; an empty table yields no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import trimmed, with_offsets, written
from .tokens import encoder

CAPACITY = 2048
SENTENCE_PENALTY = 2.0
TOKEN_PENALTY = 8.0
#: Without a sentence end, nodes stand this many tokens apart.
STRIDE = 16
BLOCK_TOKENS = 1 << 21
#: A tail is cut further while that saves more padding than this a cut.
TAIL_PENALTY = 4
# Characters that end a sentence.
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？")


def sentence_table(tok) -> np.ndarray:
    """Which ids end a sentence."""
    table = np.zeros(tok.get_vocab_size(), bool)
    for token, i in tok.get_vocab().items():
        table[i] = token.removesuffix("</w>").endswith(SENTENCE_ENDS)
    return table


def nodes_of(ends: np.ndarray, doc_ends: np.ndarray, total: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and their penalties; neighbours lie at most ``stride`` apart."""
    at_end = np.zeros(total + 1, bool)
    at_end[ends] = at_end[doc_ends] = at_end[total] = True
    soft = np.flatnonzero(at_end)
    soft = soft[soft > 0]
    gaps = np.diff(np.r_[0, soft])
    fill = (gaps - 1) // stride  # places between a soft one and the one before
    last = np.cumsum(fill + 1) - 1  # where the soft ones stand among all
    pos = np.repeat(soft - gaps, fill + 1) + stride * (np.arange(last[-1] + 1) - np.repeat(last - fill, fill + 1) + 1)
    pos[last] = soft
    at_doc = np.zeros(total + 1, bool)
    at_doc[doc_ends] = True
    cost = np.full(len(pos), TOKEN_PENALTY)
    cost[last] = np.where(at_doc[soft], 0.0, SENTENCE_PENALTY)
    return pos, cost


def best_cuts(pos: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Places where sequences end, at least total cost, leaving an open tail of at most ``capacity`` tokens.

    The tail costs nothing here: it goes on in the next block, or is split into powers of two.
    """
    p, c = pos.tolist(), cost.tolist()
    n = len(p)
    back = [-1] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # f(i) + pos(i), pos(i), i
    for j in range(n):
        while p[j] - queue[0][1] > capacity:
            queue.popleft()
        key, _, back[j] = queue[0]
        key += capacity + c[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p[j], j))
    tail = [(key - place, -place, i) for key, place, i in queue if p[-1] - place <= capacity] if n else []
    cuts, j = [], min(tail)[2] if tail else -1
    while j >= 0:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def tail_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """A tail of n tokens as sequences: powers of two first, a padded rest where cutting on isn't worth it."""
    out = []
    while n and capacity - n > TAIL_PENALTY * bin(n).count("1") and n & (n - 1):
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return [*out, n] if n else out


def _packer(path: str, end_id: int, capacity: int, specials: bool):
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_sequence", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path, lead=False, specials=specials)
        table = sentence_table(enc.tok)
        end = np.array([end_id], enc.dtype)
        sequence = 0
        kept: list[tuple[object, int, int, np.ndarray]] = []  # doc id, tokens, ids before, ids left

        def emit(cut_at: list[int], held: list[tuple[object, int, int, np.ndarray]]) -> list[tuple]:
            nonlocal sequence
            rows, at, begin, k = [], 0, 0, 0
            for doc, n, before, ids in held:
                used = 0
                while used < len(ids) and k < len(cut_at):
                    take = min(len(ids) - used, cut_at[k] - at)
                    piece = ids[used : used + take]
                    rows.append((doc, before + used, take, zlib.crc32(piece.astype("<u4").tobytes()), n, part, sequence, at - begin))
                    used, at = used + take, at + take
                    if at == cut_at[k]:
                        sequence, begin, k = sequence + 1, at, k + 1
                if used < len(ids):
                    rest.append((doc, n, before + used, ids[used:]))
            return rows

        def pack(held: list, last: bool) -> list[tuple]:
            sizes = np.array([len(h[3]) for h in held])
            total = int(sizes.sum())
            if not total:
                return []
            every = np.concatenate([h[3] for h in held])
            pos, cost = nodes_of(np.flatnonzero(table[every]) + 1, np.cumsum(sizes), total)
            cuts = best_cuts(pos, cost, capacity)
            begin = cuts[-1] if cuts else 0
            if last:
                for n in tail_lengths(total - begin, capacity):
                    begin += n
                    cuts.append(begin)
            return emit(cuts, held)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=fields)

        size = 0
        rest: list = []
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                kept.append((doc, len(ids), 0, ids))
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    rest = []
                    if rows := pack(kept, False):
                        yield batch(rows)
                    kept, size = rest, sum(len(r[3]) for r in rest)
        rest = []
        if rows := pack(kept, True):
            yield batch(rows)

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, specials: bool = False) -> DataFrame:
    """A row per piece. Local sequence numbers become global by one small prefix sum over tasks. ``specials``: see ``tokens``."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local_sequence long, offset long"
    pieces = written(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(trimmed(_packer(tokenizer_path, end_id, capacity, specials)), schema))
    parts = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("n"))
    return pieces.join(with_offsets(parts, "part", "n", "first"), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("local_sequence")).alias("sequence_id"), "offset"
    )
