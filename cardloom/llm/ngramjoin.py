"""N-gram Jaccard join by rare-first prefixes.

1. Each text becomes the set of its distinct 4-word shingles (64-bit hashes).
   Texts of one set form a class; one member stands for it.
2. Shingles meet in buckets of their hashes, which tells how many classes hold
   each. A class of size n whose shared shingles are less than the threshold's
   part of n has no partner (length filter against itself) and goes. Within a
   task's batch equal shingles are merged before they move.
3. Of the classes left, shingles are counted anew and ordered from rare to
   frequent. Two sets with intersection at least o share one of their first
   n - ceil(t * n) + 1 shingles, so only these prefixes are joined. A row of a
   prefix carries the set's size, the shingle's place and a histogram of the
   shingles after it, so that blocks apply the length, positional and suffix
   filters without the sets: after the first shingle in common the intersection
   is at most 1 + the least number of shingles left (positional), and at most
   1 + half of both numbers less the histograms' distance (suffix).
4. Candidates are made distinct, so that each pair is verified once, on full sets.

Copies with edits share prefixes by thousands. Members of a prefix are first held
against a hub, the member that most others meet; then against the best member of
each other component; then all pairs whose ends are still in different
components meet in blocks of bounded rows. No pair within a component is
needed, no prefix is capped, and no task holds one whole.

Links are exact: a pair at the threshold or above always has a common prefix
shingle and passes the filters, which are bounds. Shingles are told apart by 64
bits; in step 2 by 32 bits within a bucket, where a chance match only keeps a
class that could have gone.

Defined cases: null and wordless texts have no shingles and are linked with
nothing; a text with fewer words than a shingle has one shingle, the whole
sequence; rows that repeat an id each yield a row; a null id counts as larger than
any other; ties between hubs go to the smaller row; an empty table yields no
rows; other columns are ignored, whatever their names; ids may be of any type
that has an order; very long texts are shingled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .base import discard, trimmed, written
from .graph import components


class Rule(NamedTuple):
    """Shingles of so many words link at intersection / union >= num / den."""

    shingle: int = 4
    num: int = 85
    den: int = 100


#: Shingles that meet in one task, about.
BUCKET = 1 << 21
#: Shingles with over a HOT-th of all occurrences, and over HOT_LEAST, aren't sent in step 3: there are less than HOT of them.
HOT = 100_000
HOT_LEAST = 4096
#: Rows of a prefix shingle that meet in one task, at most about so many on either side.
BLOCK = 2048
#: Members of one hub in a task's group.
HUB_ROWS = 512
HUB_ROUNDS = 2
PROBE_ROUNDS = 2
#: Parts of the histogram of what follows a shingle.
CELLS = 16


def _run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of the hash, so that the lower half tells shingles of a bucket apart."""
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


# --- step 2: which shingles are shared ----------------------------------------


def _postings(batches: Iterator[pa.RecordBatch], rule: Rule, buckets: int) -> Iterator[pa.RecordBatch]:
    """(cid, text) to a row a bucket: its classes, how many shingles each has there, the shingles; and those that the batch itself has more than once, with counts."""
    for b in batches:
        cids = b.column(0).to_numpy()
        sets = list(neardup.batch_sets(b.column(1), rule.shingle))
        if not sets:
            continue
        x, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(x, kind="stable")
        x, own = x[order], own[order]
        starts = _run_starts(x)
        count = np.diff(np.r_[starts, len(x)])
        several = np.repeat(count > 1, count)
        local = np.bincount(own[several], minlength=len(sets))
        rows = {k: [] for k in ("bucket", "cids", "sizes", "xs", "mx", "mc")}
        multi, times = x[starts[count > 1]], count[count > 1]
        single, owner = x[~several], own[~several]
        bs, bm = _bucket_of(single, buckets), _bucket_of(multi, buckets)
        # x is sorted, so buckets are runs; within one, shingles go by their class.
        by = np.lexsort((owner, bs))
        single, owner, bs = single[by], owner[by], bs[by]
        for k in np.unique(np.r_[bs, bm]).tolist():
            lo, hi = np.searchsorted(bs, [k, k + 1])
            o, at = owner[lo:hi], np.searchsorted(bm, [k, k + 1])
            first = _run_starts(o)
            rows["bucket"].append(k)
            rows["cids"].append(cids[o[first]].astype("<i8").tobytes())
            rows["sizes"].append(np.diff(np.r_[first, len(o)]).astype("<u4").tobytes())
            rows["xs"].append(single[lo:hi].astype("<u4").tobytes())
            rows["mx"].append(multi[at[0] : at[1]].astype("<u4").tobytes())
            rows["mc"].append(times[at[0] : at[1]].astype("<i8").tobytes())
        has = np.flatnonzero(local)
        rows["bucket"].append(-1)
        rows["cids"].append(cids[has].astype("<i8").tobytes())
        rows["sizes"].append(local[has].astype("<u4").tobytes())
        for c in ("xs", "mx", "mc"):
            rows[c].append(b"")
        yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in ("cids", "sizes", "xs", "mx", "mc")]], names=list(rows))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of equal values in the first column, over all batches."""
    key, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(0).to_numpy()
        starts = _run_starts(k)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(k)], strict=True):
            if key is not None and k[s] != key:
                yield key, parts
                parts = []
            key = int(k[s])
            parts.append(b.slice(s, e - s))
    if parts:
        yield key, parts


def _joined(parts: list[pa.RecordBatch], col: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(v for p in parts for v in p.column(col).to_pylist()), dtype)


def _block_of(cids: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _bucket_of(neardup._mix(cids.view(np.uint64)), blocks)


def _runs(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of the sorted ``key`` and where it stands."""
    starts = _run_starts(key).tolist()
    for a, b in zip(starts, [*starts[1:], len(key)]):
        yield int(key[a]), slice(a, b)


def _shared(batches: Iterator[pa.RecordBatch], hot_from: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """Per bucket a row a block of classes: how many of a class's shingles there others have; and, as block -1, very frequent shingles with their counts."""
    for bucket, parts in _grouped(batches):
        cids, found = _joined(parts, 1, "<i8"), _joined(parts, 2, "<u4").astype(np.int64)
        rows = []
        if bucket >= 0:
            xs, mx, mc = _joined(parts, 3, "<u4"), _joined(parts, 4, "<u4"), _joined(parts, 5, "<i8")
            names, inverse = np.unique(np.r_[xs, mx], return_inverse=True)
            total = np.bincount(inverse, np.r_[np.ones(len(xs), np.int64), mc], len(names)).astype(np.int64)
            per = np.r_[0, np.cumsum(total[inverse[: len(xs)]] > 1)]
            ends = np.cumsum(found)
            found = per[ends] - per[ends - found]
            hot = np.flatnonzero(total > hot_from)
            if len(hot):
                rows.append((-1, ((np.int64(bucket) << 32) | names[hot].astype(np.int64)).tobytes(), total[hot].tobytes()))
        cids, found = cids[found > 0], found[found > 0]
        block = _block_of(cids, blocks)
        by = np.argsort(block, kind="stable")
        rows += [(k, cids[by][at].tobytes(), found[by][at].tobytes()) for k, at in _runs(block[by])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "names", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a class with the sum of its counts; frequent shingles as they are, with ``hot``."""
    for block, parts in _grouped(batches):
        names, counts = _joined(parts, 1, "<i8"), _joined(parts, 2, "<i8")
        if block >= 0:
            names, inverse = np.unique(names, return_inverse=True)
            counts = np.bincount(inverse, counts, len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts), pa.array(np.full(len(names), block < 0))], names=["name", "n", "hot"])


# --- step 3: rare-first prefixes ----------------------------------------------


def _hot_at(x: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``x`` are among the sorted names ``hot`` (bucket, then 32 bits), and where."""
    if not len(hot):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    name = (_bucket_of(x, buckets) << 32) | (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
    return hot[at] == name, at


def _ask(batches: Iterator[pa.RecordBatch], buckets: int, hot_bits: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cid, full) to a row a bucket with all 64 bits of the shingles that aren't hot."""
    for b in batches:
        cids = b.column(0).to_numpy()
        sets = [np.frombuffer(f, "<u8") for f in b.column(1).to_pylist()]
        if not sets:
            continue
        x, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        cold = ~_hot_at(x, hot, hot_bits)[0]
        x, own = x[cold], own[cold]
        at = _bucket_of(x, buckets)
        by = np.lexsort((own, at))
        x, own, at = x[by], own[by], at[by]
        starts = _run_starts(at)
        rows = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            first = _run_starts(own[s:e])
            rows.append((int(at[s]), cids[own[s:e][first]].astype("<i8").tobytes(), np.diff(np.r_[first, e - s]).astype("<u4").tobytes(), x[s:e].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "cids", "sizes", "xs"])


_PACKED = "block int, cids binary, sizes binary, xs binary, dfs binary"


def _answer(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Per bucket a row a block of classes: the shingles there that others have too, and how many classes have each."""
    for _, parts in _grouped(batches):
        cids, sizes, xs = _joined(parts, 1, "<i8"), _joined(parts, 2, "<u4").astype(np.int64), _joined(parts, 3, "<u8")
        _, inverse, count = np.unique(xs, return_inverse=True, return_counts=True)
        df = count[inverse]
        keep = df > 1
        own = np.repeat(cids, sizes)[keep]
        x, df, block = xs[keep], df[keep].astype("<u4"), _block_of(own, blocks)
        by = np.lexsort((own, block))
        x, df, own, block = x[by], df[by], own[by], block[by]
        rows = []
        for k, at in _runs(block):
            first = _run_starts(own[at])
            rows.append((k, own[at][first].tobytes(), np.diff(np.r_[first, at.stop - at.start]).astype("<u4").tobytes(), x[at].tobytes(), df[at].tobytes()))
        if rows:
            yield _packed_rows(rows)


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["block", "cids", "sizes", "xs", "dfs"])


def _own(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """(cid, full) as rows of the answers' form, without counts."""
    for b in batches:
        cids = b.column(0).to_numpy()
        if len(cids):
            full = b.column(1).to_pylist()
            yield _packed_rows([(k, c.tobytes(), b"", f, None) for k, c, f in zip(_block_of(cids, blocks).tolist(), cids, full, strict=True)])


def _histograms(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of x after each of the first places: how many fall into each part of the hashes' range."""
    cell = (x >> np.uint64(60)).astype(np.int64)
    total = np.bincount(cell, minlength=CELLS)
    head = np.zeros((len(places), CELLS), np.int64)
    head[np.arange(len(places)), cell[places]] = 1
    return total - np.cumsum(head, 0)


def _prefixes(batches: Iterator[pa.RecordBatch], rule: Rule, hot_bits: int, hot: np.ndarray, hot_df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's sets and answers to the rows of its classes' prefixes: key, cid, n, left (shingles that follow), rest (their histogram).

    Unshared shingles are the rarest and stand first, so the prefix's places from
    their number on belong to shared ones. What follows a shingle is counted
    among shared shingles alone: others can't be in common.
    """

    def rows(cid: int, s: np.ndarray, x: np.ndarray, df: np.ndarray) -> tuple | None:
        n = len(s)
        is_hot, at = _hot_at(s, hot, hot_bits)
        # Hot shingles come after all others, by their own counts.
        x, df = np.r_[x, s[is_hot]], np.r_[df.astype(np.int64), hot_df[at[is_hot]] + (1 << 40)]
        prefix = n + (-rule.num * n) // rule.den + 1 - (n - len(x))
        if prefix <= 0:
            return None
        x = x[np.lexsort((x, df))]
        places = np.arange(min(prefix, len(x)))
        # Counts cut at the same height on both sides are never further apart than they were.
        rest = np.minimum(_histograms(x, places), np.iinfo(np.uint16).max).astype("<u2")
        return x[places].view(np.int64), np.full(len(places), cid), np.full(len(places), n), len(x) - 1 - places, rest

    def out(found: list[tuple]) -> pa.RecordBatch:
        key, cid, n, left, rest = (np.concatenate(c) for c in zip(*found, strict=True))
        ends = np.arange(len(rest) + 1, dtype=np.int32) * (2 * CELLS)
        wide = pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rest.tobytes())])
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (key, cid, n, left)], wide], names=["key", "cid", "n", "left", "rest"])

    for _, parts in _grouped(batches):
        parts = pa.Table.from_batches(parts)
        is_set = np.asarray(parts["dfs"].is_null())
        sets, told = parts.filter(pa.array(is_set)), parts.filter(pa.array(~is_set)).to_batches()
        cids, sizes, x, df = (_joined(told, k, t) for k, t in ((1, "<i8"), (2, "<u4"), (3, "<u8"), (4, "<u4")))
        own = np.repeat(cids, sizes)
        by = np.argsort(own, kind="stable")
        own, x, df = own[by], x[by], df[by]
        found, held = [], 0
        for c, full in zip(sets["cids"].to_pylist(), sets["xs"].to_pylist(), strict=True):
            cid = int(np.frombuffer(c, "<i8")[0])
            lo, hi = np.searchsorted(own, [cid, cid + 1])
            if r := rows(cid, np.frombuffer(full, "<u8"), x[lo:hi], df[lo:hi]):
                found.append(r)
                held += len(r[0])
            if held > 1 << 16:
                yield out(found)
                found, held = [], 0
        if found:
            yield out(found)


# --- step 3: the filters, in blocks -------------------------------------------


def _filtered(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) that pass the length, positional and suffix filters, and their bound on the intersection."""
    n, left, rest = t["n"], t["left"], t["rest"]
    lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = rule.den * lo >= rule.num * hi
    i, j = i[ok], j[ok]
    need = -(-rule.num * (n[i] + n[j]) // (rule.num + rule.den))
    ok = 1 + np.minimum(left[i], left[j]) >= need
    i, j, need = i[ok], j[ok], need[ok]
    apart = np.abs(rest[i].astype(np.int64) - rest[j].astype(np.int64)).sum(1)
    bound = 1 + (left[i] + left[j] - apart) // 2
    ok = bound >= need
    return i[ok], j[ok], bound[ok]


def _between(batches: Iterator[pa.RecordBatch], rule: Rule, probe: bool) -> Iterator[pa.RecordBatch]:
    """Rows (group, cid, label, n, left, side, rest) by group to candidates (a, b) between components.

    Within a group only rows of different sides meet, unless the group is a
    block with itself (side -1). ``probe`` reports the best pair of each two
    components alone.
    """
    for _, parts in _grouped(batches):
        t = {c: np.concatenate([p.column(k).to_numpy() for p in parts]) for k, c in ((1, "cid"), (2, "label"), (3, "n"), (4, "left"), (5, "side"))}
        t["rest"] = _joined(parts, 6, "<u2").reshape(-1, CELLS)
        m = len(t["cid"])
        if (t["label"] == t["label"][0]).all():
            continue
        found = []
        step = max(1, (1 << 18) // m)
        for a in range(0, m, step):
            i = np.repeat(np.arange(a, min(a + step, m)), m)
            j = np.tile(np.arange(m), min(a + step, m) - a)
            ok = (i < j) & (t["label"][i] != t["label"][j]) & ((t["side"][i] != t["side"][j]) | (t["side"][i] < 0))
            i, j, bound = _filtered(t, i[ok], j[ok], rule)
            if probe and len(i):
                i, j, bound = _best(t["label"], i, j, bound)
            found.append((i, j, bound))
        i, j, bound = (np.concatenate(c) for c in zip(*found, strict=True))
        if probe and len(i):
            i, j, _ = _best(t["label"], i, j, bound)
        if len(i):
            a, b = t["cid"][i], t["cid"][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _best(label: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
    order = np.lexsort((-bound, b, a))
    first = order[np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])]
    return i[first], j[first], bound[first]


def _candidates(members: DataFrame, labels: DataFrame, rule: Rule, probe: bool) -> DataFrame:
    """Distinct pairs (a, b) of classes in different components that share a prefix shingle and pass the filters.

    Members of a shingle's greatest component meet the others only; both are
    dealt into blocks of about ``BLOCK`` rows, and each pair of blocks is a group.
    """
    rows = members.join(labels.select(F.col("v").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    each = rows.groupBy("key", "label").agg(F.count("*").alias("m"))
    keys = each.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m")).where(F.col("m") > F.col("top.m"))
    blocks = lambda m: F.greatest(F.lit(1), F.ceil(m / BLOCK)).cast("int")
    keys = keys.select("key", F.col("top.label").alias("top"), F.col("m").alias("all"), blocks(F.col("top.m")).alias("tops"), blocks(F.col("m") - F.col("top.m")).alias("rests"))
    rows = rows.join(keys, "key")
    is_top, whole = F.col("label") == F.col("top"), F.col("all") <= BLOCK
    own = F.pmod(F.xxhash64("cid"), F.when(is_top, F.col("tops")).otherwise(F.col("rests"))).cast("int")
    place = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    other = F.sequence(F.lit(0), F.col("rests") - 1)
    of_top = F.transform(other, lambda r: place(F.col("own"), -1 - r, F.lit(0)))
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda t: place(t, -1 - F.col("own"), F.lit(1))),
        F.transform(other, lambda r: place(-2 - F.least(r, F.col("own")), -2 - F.greatest(r, F.col("own")), F.when(r == F.col("own"), -1).otherwise((F.col("own") > r).cast("int")))),
    )
    alone = F.array(place(F.lit(0), F.lit(0), F.lit(-1)))
    rows = rows.withColumn("own", own).withColumn("p", F.explode(F.when(whole, alone).when(is_top, of_top).otherwise(of_rest)))
    placed = rows.select(F.xxhash64("key", "p.x", "p.y").alias("group"), "cid", "label", "n", "left", F.col("p.side").cast("long").alias("side"), "rest")
    return placed.repartition("group").sortWithinPartitions("group").mapInArrow(trimmed(partial(_between, rule=rule, probe=probe)), "a long, b long").distinct()


# --- step 4: verification -----------------------------------------------------


def _holds(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(a, b, their sets) to the links."""
    for t in batches:
        ok = [neardup._linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), rule) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
        yield t.filter(pa.array(ok, pa.bool_())).select([0, 1])


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links among ``pairs`` (a, b); a set that many pairs ask for is laid out once for each ``HUB_ROWS`` of them."""
    asked = pairs.groupBy("a").agg(F.count("*").alias("m"))
    salts = F.ceil(F.col("m") / HUB_ROWS).cast("int")
    dealt = pairs.join(asked.select("a", salts.alias("salts")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    laid = asked.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(sets.select(F.col("cid").alias("a"), F.col("full").alias("x")), "a")
    both = dealt.join(sets.select(F.col("cid").alias("b"), F.col("full").alias("y")), "b").join(laid, ["a", "salt"])
    return written(both.select("a", "b", "x", "y").mapInArrow(trimmed(partial(_holds, rule=rule)), "a long, b long"))


def _hub_links(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame | None:
    """Links (a, b) of classes with the hub of one of their prefix shingles; None without any.

    The hub of a shingle is the member that shares prefixes with most others;
    each class meets one hub a round, and those without a link go on.
    """
    left, links = members.select("key", "cid"), None
    for _ in range(HUB_ROUNDS):
        sized = written(left.join(left.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"))
        if not sized.limit(1).count():
            break
        degree = sized.groupBy("cid").agg(F.sum("m").alias("degree"))
        hubs = sized.join(degree, "cid").groupBy("key").agg(F.max(F.struct("degree", (-F.col("cid")).alias("cid"))).alias("h"))
        met = sized.join(hubs, "key").where(F.col("cid") != -F.col("h.cid")).groupBy("cid").agg(F.max("h").alias("h"))
        found = _verified(met.select((-F.col("h.cid")).alias("a"), F.col("cid").alias("b")), sets, rule)
        links = found if links is None else links.unionByName(found)
        reached = found.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        left = sized.select("key", "cid").join(reached, "cid", "left_anti")
    return links


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (v, label) after more links between classes."""
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct())
    top = over.select(F.col("v").alias("label"), F.col("label").alias("top"))
    return written(labels.join(top, "label", "left").select("v", F.coalesce("top", "label").alias("label")).unionByName(over.join(labels, "v", "left_anti")))


# --- the whole ----------------------------------------------------------------


def _describe(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        sets = list(neardup.batch_sets(b.column(2), rule.shingle))
        digest = [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())], names=["doc_id", "th", "n", "digest"])


def _packed(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype("<u8").tobytes() for s in neardup.batch_sets(b.column(1), rule.shingle)], pa.binary())], names=["cid", "full"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the classes in ``wanted`` (cid, doc_id, th)."""
    w = wanted.select("cid", F.col("doc_id").alias("wid"), F.col("th").alias("wth"))
    return neardup._keyed(docs).join(w, F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).select("cid", "text")


def partners(docs: DataFrame, reps: DataFrame, rule: Rule) -> tuple[DataFrame, list, int]:
    """Classes (cid) whose shared shingles may be enough for a link; very frequent shingles with their counts; and the number of buckets.

    The list of frequent shingles has less than ``HOT`` entries at any size.
    """
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    posted = _texts(docs, reps).mapInArrow(trimmed(partial(_postings, rule=rule, buckets=buckets)), "bucket int, cids binary, sizes binary, xs binary, mx binary, mc binary")
    # What batches settled among themselves (bucket -1) stays where it is.
    key = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("cids"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    met = posted.withColumn("at", key).repartition("at").sortWithinPartitions("bucket").drop("at")
    packed = met.mapInArrow(trimmed(partial(_shared, hot_from=max(total / HOT, HOT_LEAST), blocks=buckets)), "block int, names binary, counts binary")
    told = written(packed.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(_summed), "name long, n long, hot boolean"))
    hot = sorted((r.name, r.n) for r in told.where("hot").select("name", "n").collect())
    sums = told.where("NOT hot").select(F.col("name").alias("cid"), F.col("n").alias("shared"))
    enough = written(reps.join(sums, "cid").where(rule.den * F.col("shared") >= rule.num * F.col("n")).select("cid", "doc_id", "th", "n"))
    discard(told)
    return enough, hot, buckets


def described(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per document: doc_id, n (shingles), component_id (null without shingles)."""
    keyed = neardup._keyed(docs)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    rows = written(keyed.mapInArrow(trimmed(partial(_describe, rule=rule)), f"doc_id {kind}, th long, n long, digest binary").withColumn("row", F.monotonically_increasing_id()))
    classes = written(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("cid"), F.min("doc_id").alias("least_doc")))
    # A link between different sets has at least one shingle in the union that isn't in the smaller one.
    least = -(-rule.num // (rule.den - rule.num))
    reps = written(rows.where(F.col("n") >= least).join(classes.select(F.col("cid").alias("row")), "row", "left_semi").select(F.col("row").alias("cid"), "doc_id", "th", "n"))
    enough, hot, hot_bits = partners(docs, reps, rule)
    sets = written(_texts(docs, enough).mapInArrow(trimmed(partial(_packed, rule=rule)), "cid long, full binary").dropDuplicates(["cid"]))
    names, counts = np.array([h for h, _ in hot], np.int64), np.array([c for _, c in hot], np.int64)
    total = enough.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    asked = sets.mapInArrow(trimmed(partial(_ask, buckets=buckets, hot_bits=hot_bits, hot=names)), "bucket int, cids binary, sizes binary, xs binary")
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(partial(_answer, blocks=buckets)), _PACKED)
    both = sets.mapInArrow(trimmed(partial(_own, blocks=buckets)), _PACKED).unionByName(answers).repartition("block").sortWithinPartitions("block")
    prefixes = both.mapInArrow(trimmed(partial(_prefixes, rule=rule, hot_bits=hot_bits, hot=names, hot_df=counts)), "key long, cid long, n long, left long, rest binary")
    prefixes = written(prefixes)
    several = prefixes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = written(prefixes.join(several, "key", "left_semi"))
    discard(prefixes)
    hubs = _hub_links(members, sets, rule)
    labels = components(hubs) if hubs is not None else rows.sparkSession.createDataFrame([], "v long, label long")
    for k in range(PROBE_ROUNDS + 1):
        pairs = written(_candidates(members, labels, rule, probe=k < PROBE_ROUNDS))
        if pairs.limit(1).count():
            labels = _merged(labels, _verified(pairs, sets, rule))
    owned = classes.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("component", F.coalesce("label", "cid"))
    named = owned.join(owned.groupBy("component").agg(F.min("least_doc").alias("component_id")), "component").select("digest", "component_id")
    return rows.select("doc_id", "n", "digest").join(named, "digest", "left").select("doc_id", "n", "component_id")


def report(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    of = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return described(docs, rule).select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"))
