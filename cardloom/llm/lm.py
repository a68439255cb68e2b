"""Hierarchical Pitman-Yor language model over the whole corpus.

Restaurants: one for each preceding word (the end token stands before a text),
so contexts grow with the corpus; all share one parent over single tokens, whose
base is uniform over the known tokens and one unknown. Customers of a context are
its training tokens; the tables of all contexts are the parent's customers.

1. Each block of documents lists its distinct words; one exchange counts them all
   and gives each a number. Each block then becomes pairs (preceding word, word),
   numbered within the block, and its distinct pairs, with their training counts, go
   to buckets by the preceding word as packed arrays: a pair costs some four bytes,
   never a row. Preceding words with an eighth of a bucket's share of all tokens
   (``HEAVY`` at least) are spread by the pair instead, so no bucket holds a common
   word; of these words, ``1 / HEAVY`` at most, the driver sums the table counts.
2. Tables are sampled by Gibbs. The number of tables t at which c customers eat
   one dish in a restaurant has, given the restaurant's other tables T and the
   parent's probability p of the dish, a conditional proportional to
   S(c, t) * prod_{i<t}(theta + d (T + i)) * p**t with generalised Stirling numbers S:
   what taking out and reseating its customers leaves unchanged, drawn at once.
   Beyond ``SMALL`` customers Metropolis steps on t do this, with S by its saddle
   point. A round draws all contexts' tables given the parent's last probabilities,
   sends each bucket's sums by word to the words' own buckets, draws the parent's
   tables and sends each bucket what it needs of its words. Within a round dishes
   see the other dishes' tables of the round before.
3. The predictive probability of each pair, (c - d t + (theta + d T) p) / (theta + C),
   is averaged over the rounds after ``BURN_IN`` and goes back to the blocks that
   asked for it, which score their documents.

Words are told apart by 64-bit hashes (two of 10**8 words share one with probability
3e-4). Discounts come from the counts of counts of a level's customers.

Defined cases: null text is empty and consists of one end token; a null id counts
as training text; repeated rows are learnt and scored each; very long texts are
never split over blocks; without training text the model is the uniform base; an
empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, trimmed, written
from .neardup import _mix, batch_words, chunks_of

FOLDS, HELD_OUT = 7, 2
#: Concentrations of the contexts and of their parent.
THETA, THETA0 = 1.0, 1.0
ROUNDS, BURN_IN = 4, 1
#: A block ends when it holds so many tokens; a bucket of pairs, or of words, is meant to hold so many bytes of text.
BLOCK_TOKENS, BUCKET_BYTES, WORD_BYTES = 1_500_000, 10_000_000, 64_000_000
#: Buckets of either kind there are at least.
LEAST = 8
#: As contexts, words are spread over buckets that hold this share of all tokens, or, if that is more, an eighth of a bucket's.
HEAVY = 1 / 32768
#: Answers are made for so many parts of the buckets in turn, which bounds what lies in shuffle files.
PARTS = 4
#: Dishes of more customers are sampled by Metropolis steps.
SMALL = 64
STEPS = 12
#: Up to so many tables Stirling numbers of many customers are summed, as the saddle point is off there.
FEW = 8
#: The end token's hash.
END = np.uint64(0)

# Kinds of rows between the steps.
_STATIC, _HEAVY, _WORDS, _TABLES, _PARENT, _BACK, _STATE, _ASKED, _SUM, _KNOWN, _TRAIN = range(11)
_ROW = "kind int, bucket int, wb int, block long, u long, x long, data binary"
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = ["kind", "bucket", "wb", "block", "u", "x", "data"]
_CODES = ["u1", "<u4", "<u8", "<f4", "<f8"]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: byte planes apart, compressed, since the high bytes of most numbers are zero."""
    out = []
    for a in arrays:
        code = _CODES.index(a.dtype.str.lstrip("|"))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        data = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out += [code.to_bytes(1, "little"), len(a).to_bytes(8, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = np.dtype(_CODES[data[at]]), int.from_bytes(data[at + 1 : at + 9], "little"), int.from_bytes(data[at + 9 : at + 17], "little")
        at += 17
        planes = pa.decompress(data[at : at + size], n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel())
        at += size
    return out


def _rows(rows: list[dict]) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)})


def _distinct(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (u, w), and where each distinct pair begins in it."""
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    return order, np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])][: len(u)])


def _runs(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
    return at, np.diff(np.r_[at, len(u)])


def _held(u: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``u`` are among sorted ``some``."""
    if not len(some):
        return np.zeros(len(u), bool)
    return some[np.minimum(np.searchsorted(some, u), len(some) - 1)] == u


def _bucket(u: np.ndarray, w: np.ndarray, buckets: int, heavy: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.where(_held(u, heavy), _mix(u + w * np.uint64(0x9E3779B97F4A7C15)), _mix(u))
    return ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _word_bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers are given by word buckets in turn."""
    return (w % np.uint64(buckets)).astype(np.int64)


def _rising(a: np.ndarray) -> np.ndarray:
    """Sorted numbers as their steps, which are small."""
    return np.diff(a, prepend=np.uint64(0)) if len(a) else a


def _risen(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


# --- step 1: blocks, buckets ---------------------------------------------------


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, tokens' hashes with each text's end, tokens a text), some texts at a time."""
    for chunk in chunks_of(texts):
        w, at = batch_words(chunk)
        sizes = np.diff(at) + 1
        ends = np.cumsum(sizes) - 1
        out = np.empty(len(w) + len(sizes), np.uint64)
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word], out[ends] = w, END
        yield len(sizes), out, sizes


_BLOCKS = "block long, bucket int, data binary, doc_ids array<long>, held array<boolean>, sizes array<int>, base array<double>, known array<long>"
_BLOCK_TYPES = {"bucket": pa.int32(), "data": pa.binary(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "base": pa.list_(pa.float64()), "known": pa.list_(pa.int64())}


def _block_row(block: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([cols.get(k)], t) for k, t in _BLOCK_TYPES.items())], names=["block", *_BLOCK_TYPES])


def _blocks(buckets: int):
    """Documents (doc_id, held, text) to a block's documents, as places in its list of words, and this list by word bucket, with counts in all and in training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _trim()
        part, chunk = TaskContext.get().partitionId(), 0
        ids, held, sizes, tokens, size = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            block, n = part << 24 | chunk, np.concatenate(sizes)
            words, place, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            train = np.bincount(place[np.repeat(~np.array(held, bool), n)], minlength=len(words))
            wb = ((words >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(wb, kind="stable")
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by), dtype=np.uint32)
            at, lengths = _runs(wb[by])
            for s, e in zip(at.tolist(), (at + lengths).tolist()):
                own = by[s:e]
                yield _block_row(block, bucket=int(wb[own[0]]), data=packed(_rising(words[own]), count[own].astype(np.uint32), train[own].astype(np.uint32)))
            begins = np.r_[0, np.cumsum(n)]
            for k in range(0, len(ids), 5000):
                to = min(k + 5000, len(ids))
                yield _block_row(block, data=packed(rank[place[begins[k] : begins[to]]]), doc_ids=ids[k:to], held=held[k:to], sizes=n[k:to])

        for b in batches:
            doc_ids, out, done = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            for k, w, n in _tokens(b.column(2)):
                ids += doc_ids[done : done + k]
                held += out[done : done + k]
                done += k
                tokens.append(w)
                sizes.append(n)
                size += len(w)
                if size >= BLOCK_TOKENS:
                    yield from flush()
                    chunk, size = chunk + 1, 0
                    for x in (ids, held, sizes, tokens):
                        x.clear()
                    _trim()
        if ids:
            yield from flush()

    return run


_NUMBERED = "block long, bucket int, data binary, kind int, x long"


def _numbered(buckets: int, least: float):
    """A word bucket's lists to numbers and training counts for each block; common words; sums of known words and training tokens."""

    def run(t: pa.Table) -> pa.Table:
        wb = t["bucket"][0].as_py()
        parts = [unpacked(x) for x in t["data"].to_pylist()]
        words, place = np.unique(np.concatenate([_risen(x[0]) for x in parts]), return_inverse=True)
        count, train = (np.bincount(place, np.concatenate([x[k] for x in parts]), len(words)).astype(np.uint64) for k in (1, 2))
        rows, at = [], 0
        for block, x in zip(t["block"].to_pylist(), parts, strict=True):
            own = place[at : at + len(x[0])]
            at += len(own)
            rows.append((block, wb, packed(_rising(own.astype(np.uint64)), train[own]), None, None))
        number = np.arange(len(words), dtype=np.int64) * buckets + wb
        rows += [(None, None, None, _HEAVY, k) for k in number[count >= least].tolist()]
        rows += [(None, None, None, k, int(x)) for k, x in ((_KNOWN, (train > 0).sum()), (_TRAIN, train.sum()))]
        cols = zip(*rows, strict=True)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "bucket", "data", "kind", "x"), cols, (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()), strict=True)})

    return run


def _paired(buckets: int, word_buckets: int, heavy: np.ndarray, m: dict):
    """A block's documents and its words' numbers to its documents, as places in its list of pairs and with base figures, and this list by bucket."""

    def run(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        lists = t.filter(pa.compute.is_valid(t["bucket"]))
        each = sorted((b, *unpacked(x)) for b, x in zip(lists["bucket"].to_pylist(), lists["data"].to_pylist(), strict=True))
        number = np.concatenate([_risen(x) * np.uint64(word_buckets) + np.uint64(b) for b, x, _ in each])
        c = np.concatenate([x for _, _, x in each]).astype(np.float64)
        docs = t.filter(pa.compute.is_null(t["bucket"]))
        at = [unpacked(x)[0] for x in docs["data"].to_pylist()]
        sizes = [np.array(x, np.int64) for x in docs["sizes"].to_pylist()]
        held = docs["held"].to_pylist()
        every, n = np.concatenate(at), np.concatenate(sizes)
        w = number[every]
        u = np.r_[w[-1], w[:-1]]  # every text ends with the end token, which stands before the next
        plain, known = np.log10((c + 1) / (m["N"] + m["V"] + 1)), (c > 0).astype(np.int64)
        order, first = _distinct(u, w)
        train = np.repeat(~np.concatenate([np.array(x, bool) for x in held]), n)[order]
        count = np.add.reduceat(train.astype(np.uint32), first, dtype=np.uint32)
        u, w = u[order[first]], w[order[first]]
        b = _bucket(u, w, buckets, heavy)
        by = np.argsort(b, kind="stable")
        rank = np.empty(len(by), np.uint32)
        rank[by] = np.arange(len(by), dtype=np.uint32)
        places = np.empty(len(order), np.uint32)
        places[order] = np.repeat(rank, np.diff(np.r_[first, len(order)]))
        u, w, count, b = u[by], w[by], count[by], b[by]
        runs, lengths = _runs(b)
        out = []
        for s, e in zip(runs.tolist(), (runs + lengths).tolist()):
            head, run_ = _runs(u[s:e])
            out.append(_block_row(block, bucket=int(b[s]), data=packed(_rising(u[s:e][head]), run_.astype(np.uint32), w[s:e], count[s:e])))
        begin = 0
        for ids, out_, k, own in zip(docs["doc_ids"].to_pylist(), held, sizes, at, strict=True):
            begins = np.cumsum(k) - k
            figures = {"base": np.add.reduceat(plain[own], begins), "known": np.add.reduceat(known[own], begins)}
            out.append(_block_row(block, data=packed(places[begin : begin + len(own)]), doc_ids=ids, held=out_, sizes=k, **figures))
            begin += len(own)
        return pa.Table.from_batches(out)

    return run


def _trim() -> None:
    """Freed memory goes back, and Arrow takes what it needs from the system, so that idle workers hold none."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call outside glibc
        pass


def _group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` for ``applyInArrow``, giving freed memory back before and after a group."""

    def run(t: pa.Table) -> pa.Table:
        _trim()
        out = f(t)
        del t
        _trim()
        return out

    return run


def _pairs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    parts = [unpacked(x) for x in blobs]
    u = np.concatenate([np.repeat(_risen(p[0]), p[1].astype(np.int64)) for p in parts])
    return u, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64), [len(p[2]) for p in parts]


class Bucket:
    """A bucket's pairs: contexts with runs of words (as places in ``words``) and training counts."""

    def __init__(self, data: bytes):
        contexts, runs, words, at, c = unpacked(data)
        self.contexts, self.words = _risen(contexts), _risen(words)
        self.at, self.c = at.astype(np.int64), c.astype(np.int64)
        self.runs = runs.astype(np.int64)
        self.begins = np.cumsum(self.runs) - self.runs
        self.many = np.flatnonzero(self.c > 1)

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.begins) if len(values) else values

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values, len(self.words)).astype(np.uint64)

    def totals(self, values: np.ndarray, heavy: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Of each pair's whole context; those of heavy ones are ``known``."""
        out = self.by_context(values)
        hot = _held(self.contexts, heavy)
        out[hot] = known[np.searchsorted(heavy, self.contexts[hot])]
        return np.repeat(out, self.runs)

    def told(self, bucket: int, buckets: int, t: np.ndarray, heavy: np.ndarray, names: bool = False) -> list[dict]:
        """Rows of tables by word for the words' buckets, and by heavy context; with ``names`` the words and the contexts' customers too."""
        wb = _word_bucket(self.words, buckets)
        by = np.argsort(wb, kind="stable")
        at, lengths = _runs(wb[by])
        tables = self.by_word(t)
        rows = []
        for s, e in zip(at.tolist(), (at + lengths).tolist()):
            own = by[s:e]
            rows.append({"kind": _TABLES, "bucket": bucket, "wb": int(wb[own[0]]), "data": packed(tables[own])})
            if names:
                rows.append({"kind": _WORDS, "bucket": bucket, "wb": int(wb[own[0]]), "data": packed(_rising(self.words[own]))})
        hot = np.flatnonzero(_held(self.contexts, heavy))
        sums, customers = self.by_context(t)[hot].tolist(), self.by_context(self.c)[hot].tolist()
        for k, x, y in zip(self.contexts[hot].view(np.int64).tolist(), sums, customers):
            rows.append({"kind": _HEAVY, "u": k, "x": x})
            if names:
                rows.append({"kind": _HEAVY, "u": k, "bucket": 0, "x": y})
        return [*rows, {"kind": _SUM, "u": 0, "x": int(t.sum())}]


def _merge(buckets: int, heavy: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        u, w, c, _ = _pairs(t["data"].to_pylist())
        order, first = _distinct(u, w)
        c = np.add.reduceat(c[order], first)
        u, w = u[order[first]], w[order[first]]
        words, place = np.unique(w, return_inverse=True)
        head, runs = _runs(u)
        data = packed(_rising(u[head]), runs.astype(np.uint32), _rising(words), place.astype(np.uint32), c.astype(np.uint64))
        rows = Bucket(data).told(bucket, buckets, np.minimum(c, 1), heavy, names=True)
        sums = {1: int((c == 1).sum()), 2: int((c == 2).sum())}
        return _rows([{"kind": _STATIC, "bucket": bucket, "data": data}, *rows, *({"kind": _SUM, "u": k, "x": x} for k, x in sums.items())])

    return run


# --- step 2: tables ------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, beyond eight factors."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift - np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.918938533204672742 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


@lru_cache(8)
def stirling(d: float, most: int = SMALL) -> np.ndarray:
    """log S(c, t) for c, t up to ``most``: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - d * t, 0)) + out[c, t])
    return out


@lru_cache(8)
def _saddle(d: float) -> tuple[np.ndarray, ...]:
    """Of z along the saddle point of c! / t! [z**c] g(z)**t, g(z) = (1 - (1 - z)**d) / d: log(c / t - 1), the exponent for one table and its slope, log of the variance."""
    s = np.linspace(-14, 34, 6000)
    log_y = -np.logaddexp(0, s)  # y = 1 - z
    z = -np.expm1(log_y)
    g = -np.expm1(d * log_y) / d
    h = z * np.exp((d - 1) * log_y) / g
    ok = h - 1 > 1e-7
    z, g, h, log_y = z[ok], g[ok], h[ok], log_y[ok]
    spread = h * (1 + (1 - d) * z * np.exp(-log_y) - h)
    x = np.log(h - 1)
    return x, np.log(g) - h * np.log(z), -np.log(z) * (h - 1), np.log(np.maximum(spread, 1e-300))


def _few_tables(c: np.ndarray, t: int, d: float) -> np.ndarray:
    """log S(c, t) of a small t: the sum over j of (-1)**j binom(t, j) gamma(c - j d) / gamma(-j d), over d**t t!."""
    total = np.zeros(len(c))
    for j in range(1, t + 1):
        if abs(j * d - round(j * d)) > 1e-9:  # else gamma has a pole there
            total += (-1) ** j * math.comb(t, j) / math.gamma(-j * d) * np.exp(lgamma(c - j * d) - lgamma(c - d))
    return np.log(np.maximum(total, 1e-300)) + lgamma(c - d) - t * math.log(d) - math.lgamma(t + 1)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) of large c, 1 <= t <= c: by the saddle point, of few tables by their sum."""
    x, value, slope, spread = _saddle(d)
    at = np.clip(np.log(np.maximum(c / t - 1, 1e-300)), x[0], x[-1])
    k = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    step = x[k + 1] - x[k]
    f = (at - x[k]) / step
    hermite = value[k] * (1 + 2 * f) * (1 - f) ** 2 + slope[k] * step * f * (1 - f) ** 2 + value[k + 1] * f * f * (3 - 2 * f) - slope[k + 1] * step * f * f * (1 - f)
    out = lgamma(c + 1.0) - lgamma(t + 1.0) + t * hermite - 0.5 * (np.log(2 * np.pi * t) + spread[k] + (spread[k + 1] - spread[k]) * f)
    for k in range(1, FEW + 1):
        if (few := t == k).any():
            out[few] = _few_tables(c[few], k, d)
    return np.where(t >= c, 0.0, out)


def draw_tables(c: np.ndarray, other: np.ndarray, p: np.ndarray, t: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, given the restaurants' other tables and the parent's probabilities; ``t`` are the last ones."""
    out = np.minimum(c, 1)
    few = np.flatnonzero((c > 1) & (c <= SMALL))
    few = few[np.argsort(c[few], kind="stable")]
    table = stirling(d)
    at, lengths = _runs(c[few])
    for s, e in zip(at.tolist(), (at + lengths).tolist()):
        rows = few[s:e]
        n = int(c[rows[0]])
        log = np.cumsum(np.log(theta + d * (other[rows][:, None] + np.arange(n))) + np.log(p[rows])[:, None], 1) + table[n, 1 : n + 1]
        reach = np.cumsum(np.exp(log - log.max(1, keepdims=True)), 1)
        out[rows] = 1 + (reach < (rng.random(len(rows)) * reach[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(c > SMALL)
    if len(many):
        n, o, log_p = c[many].astype(np.float64), other[many].astype(np.float64), np.log(p[many]) + np.log(d)
        # About as many as customers who come one by one would open: the start of a dish, and the scale of all its steps.
        seen, tables = np.ones(len(n)), np.ones(len(n))
        grow = n ** (1 / 40)
        for _ in range(40):
            weight = (theta + d * (o + tables)) * p[many]
            tables += (grow - 1) * seen * weight / (weight + np.maximum(seen - d * tables, 1e-9))
            seen *= grow
        now = np.where(t[many] > 1, t[many], np.clip(np.round(tables), 1, n))
        scales = [np.maximum(1.0, k * np.sqrt(tables)) for k in (0.7, 1.5, 3.0)]
        weigh = lambda k: log_stirling(n, k, d) + k * log_p + lgamma(theta / d + o + k)
        current = weigh(now)
        for step in range(STEPS):
            new = now + np.round(rng.standard_normal(len(n)) * scales[step % 3])
            ok = (new >= 1) & (new <= n)
            trial = weigh(np.where(ok, new, now))
            ok &= np.log(rng.random(len(n))) < trial - current
            now, current = np.where(ok, new, now), np.where(ok, trial, current)
        out[many] = now.astype(out.dtype)
    return out


def _discount(n1: int, n2: int) -> float:
    return round(min(0.95, max(0.05, n1 / (n1 + 2 * n2))), 4) if n1 else 0.5


def _parent(m: dict, round_: int):
    """Rows of a word bucket (words, tables, the last state) to its new state and, for each bucket, customers less discounts of its words."""

    def run(t: pa.Table) -> pa.Table:
        wb = t["wb"][0].as_py()
        by: dict[int, dict[int, bytes]] = {_WORDS: {}, _TABLES: {}, _PARENT: {}}
        for kind, bucket, data in zip(t["kind"].to_pylist(), t["bucket"].to_pylist(), t["data"].to_pylist(), strict=True):
            by[kind][bucket or 0] = data
        buckets = sorted(by[_WORDS])
        named = [_risen(unpacked(by[_WORDS][b])[0]) for b in buckets]
        words, place = np.unique(np.concatenate(named), return_inverse=True)
        c0 = np.bincount(place, np.concatenate([unpacked(by[_TABLES][b])[0] for b in buckets]), len(words)).astype(np.int64)
        t0 = np.minimum(c0, 1)
        if by[_PARENT]:
            rng = np.random.default_rng([round_, wb, 1])
            t0 = unpacked(by[_PARENT][0])[0].astype(np.int64)
            t0 = draw_tables(c0, np.maximum(m["T0"] - t0, 0), np.full(len(c0), 1 / (m["V"] + 1)), t0, m["d0"], THETA0, rng)
        rows = [{"kind": _PARENT, "wb": wb, "data": packed(t0.astype(np.uint64))}]
        sums = {5: int((c0 == 1).sum()), 6: int((c0 == 2).sum()), 7: int(t0.sum())}
        rows += [{"kind": _SUM, "u": k, "x": x} for k, x in sums.items()]
        at = 0
        for b, x in zip(buckets, named, strict=True):
            own = place[at : at + len(x)]
            at += len(x)
            rows.append({"kind": _BACK, "bucket": b, "wb": wb, "x": round_, "data": packed(c0[own].astype(np.uint64), t0[own].astype(np.uint64))})
        return _rows(rows)

    return run


class Sample:
    """What a bucket knows of one round: its tables, by pair, and the parent's probabilities of its words."""

    def __init__(self, t: pa.Table, b: Bucket, buckets: int, m: dict, total: dict):
        rows = t.filter(pa.compute.equal(t["x"], total["round"]))
        back = rows.filter(pa.compute.equal(rows["kind"], _BACK)).sort_by("wb")
        parts = [unpacked(x) for x in back["data"].to_pylist()]
        by = np.argsort(_word_bucket(b.words, buckets), kind="stable")
        self.p = np.empty(len(b.words))
        self.p[by] = np.concatenate([c0 - m["d0"] * t0 for c0, t0 in parts])
        self.p = (self.p + (THETA0 + m["d0"] * total["T0"]) / (m["V"] + 1)) / (THETA0 + total["C0"])
        self.tables = np.minimum(b.c, 1)
        for x in rows.filter(pa.compute.equal(rows["kind"], _STATE))["data"].to_pylist():
            self.tables[b.many] = unpacked(x)[0]


def _bucket_of(t: pa.Table) -> tuple[int, Bucket]:
    return t["bucket"][0].as_py(), Bucket(t.filter(pa.compute.equal(t["kind"], _STATIC))["data"][0].as_py())


def _predictive(b: Bucket, t: np.ndarray, all_tables: np.ndarray, customers: np.ndarray, p: np.ndarray, m: dict) -> np.ndarray:
    return (b.c - m["d"] * t + (THETA + m["d"] * all_tables) * p[b.at]) / (THETA + customers)


def _contexts(m: dict, total: dict, buckets: int, heavy: np.ndarray, round_: int):
    """A bucket's rows to its tables drawn anew, told to the words."""

    def run(t: pa.Table) -> pa.Table:
        bucket, b = _bucket_of(t)
        last = Sample(t, b, buckets, m, total)
        k, tables = b.many, last.tables
        other = b.totals(tables, heavy, total["heavy"])[k] - tables[k]
        tables[k] = draw_tables(b.c[k], np.maximum(other, 0), last.p[b.at[k]], tables[k], m["d"], THETA, np.random.default_rng([round_, bucket, 0]))
        return _rows([{"kind": _STATE, "bucket": bucket, "x": round_, "data": packed(tables[k].astype(np.uint64))}, *b.told(bucket, buckets, tables, heavy)])

    return run


def _answers(m: dict, totals: list[dict], buckets: int, heavy: np.ndarray):
    """A bucket's rows and the blocks' pairs to averaged predictive probabilities, in the order asked."""

    def run(t: pa.Table) -> pa.Table:
        asked = t.filter(pa.compute.equal(t["kind"], _ASKED))
        bucket, b = _bucket_of(t)
        customers = b.totals(b.c, heavy, m["customers"])
        mean = np.zeros(len(b.c))
        for total in totals:
            one = Sample(t, b, buckets, m, total)
            mean += _predictive(b, one.tables, b.totals(one.tables, heavy, total["heavy"]), customers, one.p, m) / len(totals)
        u, w, _, sizes = _pairs(asked["data"].to_pylist())
        order, first = _distinct(u, w)  # the bucket's pairs are just these, in this order
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        ends = np.cumsum(sizes)
        data = [packed(mean[number[e - n : e]].astype(np.float32)) for n, e in zip(sizes, ends.tolist(), strict=True)]
        return pa.table({"block": asked["block"].combine_chunks(), "bucket": pa.array([bucket] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def _sums(df: DataFrame) -> dict[int, int]:
    return {r.u: int(r.x) for r in df.where(F.col("kind") == _SUM).groupBy("u").agg(F.sum("x").alias("x")).collect()}


def fit(pairs: DataFrame, word_buckets: int, heavy: np.ndarray, known: int) -> tuple[DataFrame, dict, list[dict], list[DataFrame]]:
    """``pairs`` (bucket, data) to what answers need, by bucket; the model's figures, those of each round kept, and the tables to discard after."""
    merged = written(pairs.groupBy("bucket").applyInArrow(_group(_merge(word_buckets, heavy)), _ROW))
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    place = {int(k): i for i, k in enumerate(heavy.view(np.int64).tolist())}

    def by_heavy(df: DataFrame) -> np.ndarray:
        out = np.zeros(len(heavy), np.int64)
        for r in of(df, _HEAVY).groupBy("u").agg(F.sum("x").alias("x")).collect() if len(heavy) else []:
            out[place[r.u]] = r.x
        return out

    def parents(tables: DataFrame, *last: DataFrame) -> DataFrame:
        told = of(merged, _WORDS).unionByName(of(tables, _TABLES))
        for df in last:
            told = told.unionByName(of(df, _PARENT))
        return written(told.groupBy("wb").applyInArrow(_group(_parent({**m, **total}, total["round"])), _ROW))

    sums = _sums(merged)
    m: dict = {"V": known, "d": _discount(sums.get(1, 0), sums.get(2, 0)), "d0": 0.5, "customers": by_heavy(merged.where("bucket IS NOT NULL"))}
    total = {"round": 0, "C0": sums.get(0, 0), "T0": 0, "heavy": by_heavy(merged.where("bucket IS NULL"))}
    parent, tables = parents(merged), None
    sums = _sums(parent)
    m["d0"] = _discount(sums.get(5, 0), sums.get(6, 0))
    total["T0"] = sums.get(7, 0)
    static, kept, totals = of(merged, _STATIC), [], []
    for r in range(1, ROUNDS + 1):
        told = static.unionByName(of(parent, _BACK))
        told = told if tables is None else told.unionByName(of(tables, _STATE))
        new = written(told.groupBy("bucket").applyInArrow(_group(_contexts(m, dict(total), word_buckets, heavy, r)), _ROW))
        total = {"round": r, "C0": _sums(new).get(0, 0), "T0": total["T0"], "heavy": by_heavy(new)}
        fresh = parents(new, parent)
        total["T0"] = _sums(fresh).get(7, 0)
        for df in (parent, tables) if r <= BURN_IN + 1 else ():
            if df is not None:
                discard(df)
        parent, tables = fresh, new
        if r > BURN_IN:
            kept += [fresh, new]
            totals.append(total)
    for df in kept:
        static = static.unionByName(of(df, _BACK, _STATE))
    return static, m, totals, [merged, *kept]


# --- step 3: scores ------------------------------------------------------------


def _scorer(train_tokens: int):
    def run(t: pa.Table) -> pa.Table:
        answers = t.filter(pa.compute.is_valid(t["bucket"])).sort_by("bucket")
        own = np.log10(np.concatenate([unpacked(x)[0] for x in answers["data"].to_pylist()]).astype(np.float64))
        docs = t.filter(pa.compute.is_null(t["bucket"]))
        scores = []
        for data, sizes in zip(docs["data"].to_pylist(), docs["sizes"].to_pylist(), strict=True):
            scores.append(np.add.reduceat(own[unpacked(data)[0]], np.cumsum(sizes) - sizes))
        flat = lambda k: pa.concat_arrays([x.flatten() for x in docs[k].chunks])
        cols = {"doc_id": flat("doc_ids"), "held_out": flat("held"), "n_tokens": flat("sizes").cast(pa.int64()), "n_known": flat("known")}
        n = len(cols["doc_id"])
        return pa.table({**cols, "train_tokens": pa.array([train_tokens] * n, pa.int64()), "base_score": flat("base"), "score": pa.array(np.concatenate(scores))})

    return run


def score(docs: DataFrame, *, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Trains on the documents whose crc32(id as text) modulo ``folds`` isn't ``held_out`` and scores all of them."""
    text = F.col("text").cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, words = max(LEAST, -(-size // BUCKET_BYTES)), max(LEAST, -(-size // WORD_BYTES))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_out
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (held & F.col("doc_id").isNotNull()).alias("held"), text.alias("text"))
    lists = written(read.mapInArrow(trimmed(_blocks(words)), _BLOCKS))
    total = lists.where("bucket IS NULL").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0
    numbers = written(lists.where("bucket IS NOT NULL").select("block", "bucket", "data").groupBy("bucket").applyInArrow(_group(_numbered(words, max(HEAVY, 1 / (8 * buckets)) * total)), _NUMBERED))
    common = [r.x for r in numbers.where(F.col("kind") == _HEAVY).select("x").collect()]  # 1 / HEAVY at most
    sums = {r.kind: int(r.x) for r in numbers.where(F.col("kind").isin(_KNOWN, _TRAIN)).groupBy("kind").agg(F.sum("x").alias("x")).collect()}
    heavy = np.sort(np.array(common, np.int64).view(np.uint64))
    n, v = sums.get(_TRAIN, 0), sums.get(_KNOWN, 0)
    none = lambda kind: F.lit(None).cast(kind)
    wide = lambda df: df.select("block", "bucket", "data", none("array<bigint>").alias("doc_ids"), none("array<boolean>").alias("held"), none("array<int>").alias("sizes"), none("array<double>").alias("base"), none("array<bigint>").alias("known"))
    told = lists.where("bucket IS NULL").unionByName(wide(numbers.where("kind IS NULL")))
    blocks = written(told.groupBy("block").applyInArrow(_group(_paired(buckets, words, heavy, {"N": n, "V": v})), _BLOCKS))
    discard(lists)
    discard(numbers)
    pairs = blocks.where("bucket IS NOT NULL")
    known, m, totals, done = fit(pairs.select("bucket", "data"), words, heavy, v)
    asked = pairs.select(F.lit(_ASKED).alias("kind"), "bucket", none("int").alias("wb"), "block", none("long").alias("u"), none("long").alias("x"), "data")
    rows = known.unionByName(asked)
    answers = [written(rows.where(F.col("bucket") % PARTS == k).groupBy("bucket").applyInArrow(_group(_answers(m, totals, words, heavy)), "block long, bucket int, data binary")) for k in range(PARTS)]
    for df in done:
        discard(df)
    both = blocks.where("bucket IS NULL")
    for df in answers:
        both = both.unionByName(wide(df))
    out = both.groupBy("block").applyInArrow(_group(_scorer(n)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
