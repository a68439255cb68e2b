"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes the set of its distinct 3-word shingles (64-bit hashes).
   Texts with the same set form a class; one member stands for it, so exact
   copies never meet in pairs.
2. ``BANDS`` bands of ``ROWS`` MinHash values propose candidates. Members of a
   large band are first held against its hub, the member that most others meet,
   exactly and one hub a member, ``HUB_ROUNDS`` times. What is left of a band are
   the pairs between its components: members of the greatest one meet only the
   others, in blocks of bounded rows and shingles, so no band is capped and no
   task holds a band.
3. Signatures are compared ``STEP`` values at a time. After each step a pair
   goes if the posterior probability of similarity >= 0.85 is below ``MISS``.
   In large bands a lossless bound joins in (shingles found in one class only
   can't be shared), and rows carry their full sets: a widely edited text has
   many candidates and few links, which are told apart inside the block, and of
   which a spanning forest of the components is reported.
4. Other survivors are verified on full sets. A first round links dense groups,
   those of large bands by hubs, others by stars around their most connected
   member; the second tests every pair whose ends are still in different
   components, so no pair within a component is ever needed.

Links are exact in one direction: a reported link always holds. A pair at 0.85
itself shares no band with probability (1 - 0.85**5)**25 = 4e-7. The band that
reports a pair is the first whose whole key both have, the key they met by.

Shingle size, threshold and the bands fitted to them are a ``Measure``: ``OP3``,
as above, or ``FIVE_WORDS``, 5-word shingles and 0.8 in 30 bands of 4, where a
pair at 0.8 shares none with probability (1 - 0.8**4)**30 = 1e-7.

Defined cases: null and wordless texts have no shingles and are linked with
nothing; rows that repeat an id each yield a row; a null id counts as larger
than any other; an empty table yields no rows; other columns are ignored by
``report`` and kept by ``deduplicate``, whatever their names; ids may be of any
type that has an order; very long texts are shingled whole, and blocks of bands
hold a bounded number of shingles; of documents with equal least ids one row stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .base import free_names, trimmed, written
from .graph import components

#: Bytes of text worked on at once.
CHUNK_BYTES = 4 << 20
#: The same where sets are made, beside which a worker holds their sketches.
SET_BYTES = 1 << 20
SHINGLE = 3
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Link when NUM * union <= DEN * intersection.
NUM, DEN = 85, 100
STEP = 25
MISS = 1e-6
BLOCK = 1024
#: A block holds about so many shingles at most, unless one set alone has more.
BLOCK_SHINGLES = 1 << 20
#: So often members of large bands are held against hubs, each against one, of HUB_ROWS members a task's group.
HUB_ROUNDS = 2
HUB_ROWS = 512
#: Bands with more members use the bound on unshared shingles.
LARGE = 64
#: The first round looks at so many bands.
STAR_BANDS = 6
#: Stars are built from pairs whose signatures agree at least so often, which links seldom fail.
STAR_MATCHES = 108
#: Groups of so few members report their surviving pairs without a star.
SMALL = 8


class Measure(NamedTuple):
    """When two texts are near copies, and the bands that find them."""

    shingle: int
    num: int
    den: int
    bands: int
    rows: int
    step: int
    star_matches: int

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


OP3 = Measure(SHINGLE, NUM, DEN, BANDS, ROWS, STEP, STAR_MATCHES)
FIVE_WORDS = Measure(5, 80, 100, 30, 4, 24, 98)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_WORDS: dict[bytes, int] = {}
_WORD_CACHE = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words (A-Z only), split at space and \\t\\n\\v\\f\\r."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    cache = _WORDS
    try:
        return np.fromiter((cache[w] for w in words), np.uint64, len(words))
    except KeyError:
        pass
    if len(cache) > _WORD_CACHE:
        cache.clear()
    digest = xxhash.xxh3_64_intdigest
    for w in words:
        if w not in cache:
            cache[w] = digest(w)
    return np.fromiter((cache[w] for w in words), np.uint64, len(words))


def chunks_of(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes, one text at least, null as empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of all texts, one after another, and the places where texts begin and end; by whole columns."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.values.dictionary_encode()
    codes, names = np.asarray(words.indices), words.dictionary.cast(pa.binary())
    real = (np.asarray(pc.binary_length(names)) > 0)[codes]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names.to_numpy(zero_copy_only=False)), np.uint64, len(names))[codes]
    return hashes[real], np.r_[0, np.cumsum(real)][np.asarray(split.offsets)]


def shingle_sequence(w: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The hash of each run of k words; of the whole sequence if it is shorter."""
    n = len(w)
    if not n:
        return w
    with np.errstate(over="ignore"):
        run = min(k, n)
        out = np.full(n - run + 1, np.uint64(run), np.uint64)
        for j in range(run):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + w[j : n - run + 1 + j])
        return out


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_sequence(word_hashes(text), k))


def batch_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """``shingle_set`` of each text."""
    for chunk in chunks_of(texts, SET_BYTES):
        w, at = batch_words(chunk)
        for a, b in zip(at.tolist(), at[1:].tolist()):
            yield np.unique(shingle_sequence(w[a:b], k))


def signature(s: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    rng = np.random.default_rng(1)
    a = (rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)[:, None]
    out = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 1024):
            part = ((s[None, at : at + 1024] * a + b) >> np.uint64(32)).min(1).astype(np.uint32)
            np.minimum(out, part, out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        for col in sig.reshape(bands, -1).T:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + col.astype(np.uint64))
    return key.view(np.int64)


def least_matches(threshold: float = NUM / DEN, miss: float = MISS, hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, fewest matches that go on) after each step.

    The prior is uniform; a byte of a MinHash value agrees with probability
    s + (1 - s) / 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for m in range(step, hashes + 1, step):
        k = np.arange(m + 1)[:, None]
        log = k * np.log(p) + (m - k) * np.log1p(-p)
        like = np.exp(log - log.max(1, keepdims=True))
        tail = like[:, s >= threshold].sum(1) / like.sum(1)
        out.append((m, int(np.argmax(tail >= miss))))
    return out


# --- step 1: sets, classes, signatures ---------------------------------------


def _describe(batches: Iterator[pa.RecordBatch], by: Measure = OP3) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, sketch, bands, keys = [], [], [], [], []
        for s in batch_sets(b.column(2), by.shingle):
            n.append(len(s))
            if not len(s):
                digest.append(None), sketch.append(None), bands.append(None), keys.append(None)
                continue
            digest.append(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest())
            sig = signature(s, by.hashes)
            sketch.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
            bands.append(band_keys(sig, by.bands))
            keys.append(bands[-1].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(keys, pa.binary())],
            names=["doc_id", "th", "n", "digest", "sketch", "bands", "keys"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    text, doc_id = F.col("text").cast("string"), F.col("doc_id")
    doc_id = doc_id.cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else doc_id
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], by: Measure = OP3) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = list(batch_sets(b.column(1), by.shingle))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["cid", "s", "full"])


def _sets_of(docs: DataFrame, wanted: DataFrame, by: Measure = OP3) -> DataFrame:
    """Full sets, made anew from the texts, of the classes in ``wanted`` (cid, doc_id, th)."""
    d = _keyed(docs)
    joined = d.join(wanted.select("cid", F.col("doc_id").alias("wid"), F.col("th").alias("wth")), F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))
    return joined.select("cid", "text").mapInArrow(trimmed(partial(_sets, by=by)), "cid long, s array<long>, full binary")


# --- steps 2 and 3: blocks of a band ------------------------------------------


def _forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs to report: stars around the most connected members, until every pair's ends lie in one star."""
    keep = np.zeros(len(i), bool)
    open_pairs = np.ones(len(i), bool)
    while open_pairs.any():
        rows = np.flatnonzero(open_pairs)
        v, degree = np.unique(np.r_[i[rows], j[rows]], return_counts=True)
        center = v[np.argmax(degree)]
        own = rows[(i[rows] == center) | (j[rows] == center)]
        keep[own] = True
        members = np.unique(np.r_[i[own], j[own]])
        inside = np.isin(i[rows], members) & np.isin(j[rows], members)
        open_pairs[rows[inside]] = False
    return keep


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) between components a spanning forest needs."""
    up: dict[int, int] = {}
    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while (z := up.get(x, x)) != x:
            up[x] = x = up.get(z, z)
        while (z := up.get(y, y)) != y:
            up[y] = y = up.get(z, z)
        if x != y:
            up[x] = y
            keep[k] = True
    return keep


def _compare(star: bool, by: Measure = OP3):
    steps = least_matches(by.num / by.den, hashes=by.hashes, step=by.step)
    num, den = by.num, by.den

    def survivors(sk: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        alive = np.arange(len(i))
        same = np.zeros(len(i), np.int32)
        before = 0
        for m, least in steps:
            same[alive] += (sk[i[alive], before:m] == sk[j[alive], before:m]).sum(1)
            alive = alive[same[alive] >= least]
            before = m
            if not len(alive):
                break
        return alive

    def groups(t: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs to report, as row numbers, from whole groups."""
        size = ends - starts
        label, n, u, side, cross = t["label"], t["n"], t["u"], t["side"], t["bi"] != t["bj"]

        def tested(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (label[i] != label[j]) & (~cross[i] | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            most = np.minimum(n[i] - u[i], n[j] - u[j])
            ok = (num + den) * most >= num * (n[i] + n[j])
            i, j = i[ok], j[ok]
            k = survivors(t["sketch"], i, j)
            i, j = i[k], j[k]
            # Of the bands that a pair shares, the first alone reports it.
            first = np.argmax(t["keys"][i] == t["keys"][j], axis=1) == t["band"][i]
            i, j = i[first], j[first]
            # Members of large bands carry their full sets and are verified here.
            full = t["full"]
            ok = [full[a] is None or full[b] is None or _linked(full[a], full[b], by) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            ok = np.array(ok, bool)
            return i[ok], j[ok]

        for d in range(1, SMALL):  # small groups together, by distance in the group
            few = np.flatnonzero((size <= SMALL) & (size > d))
            if len(few):
                i = np.concatenate([np.arange(s, e - d) for s, e in zip(starts[few], ends[few], strict=True)])
                yield tested(i, i + d)
        for g in np.flatnonzero(size > SMALL):
            s, e = starts[g], ends[g]
            if (label[s:e] == label[s]).all():
                continue
            found_i, found_j = [], []
            rows = max(1, (1 << 18) // (e - s))
            for a in range(s, e, rows):
                i = np.repeat(np.arange(a, min(a + rows, e)), e - s)
                j = np.tile(np.arange(s, e), min(a + rows, e) - a)
                up = i < j
                x, y = tested(i[up], j[up])
                found_i.append(x)
                found_j.append(y)
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            if t["full"][s] is not None:  # links, not candidates: those that join components say all
                k = _spanning(label[i], label[j])
                i, j = i[k], j[k]
            elif star and len(i):
                sure = (t["sketch"][i] == t["sketch"][j]).sum(1) >= by.star_matches
                i, j = i[sure], j[sure]
                k = _forest(i, j)
                i, j = i[k], j[k]
            yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(t: pa.Table, whole: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            key = t["key"].to_numpy()
            bi, bj = t["bi"].to_numpy(), t["bj"].to_numpy()
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            ends = np.r_[new[1:], len(key)]
            last = len(key) if whole else new[-1]
            new, ends = new[ends <= last], ends[ends <= last]
            out = []
            if len(new):
                cols = {c: t[c].to_numpy() for c in ("label", "n", "u", "side", "cid", "band")} | {"bi": bi, "bj": bj}
                cols["sketch"] = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, by.hashes)
                cols["keys"] = np.frombuffer(b"".join(t["keys"].to_pylist()), "<i8").reshape(-1, by.bands)
                cols["full"] = [x if x is None else np.frombuffer(x, "<u8") for x in t["full"].to_pylist()]
                pairs = [p for p in groups(cols, new, ends) if len(p[0])]
                if pairs:
                    a, b = (cols["cid"][np.concatenate([p[k] for p in pairs])] for k in (0, 1))
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                    out.append(pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"]))
            return out, None if whole else t.slice(last)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            out, rest = done(t, False)
            yield from out
        if rest is not None and rest.num_rows:
            yield from done(rest, True)[0]

    return run


def _candidate_pairs(members: DataFrame, info: DataFrame, labels: DataFrame, *, star: bool, by: Measure = OP3) -> DataFrame:
    """Surviving pairs (a, b) among members (key, band, cid, size) of bands."""
    label = labels.select(F.col("v").alias("cid"), "label")
    rows = members.join(info.select("cid", "n"), "cid").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    alone = F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side")))
    if star:  # small bands only
        rows = rows.drop("n").withColumn("places", alone)
    else:
        each = rows.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
        keys = each.groupBy("key").agg(F.max(F.struct("m", "label", "w")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"))
        keys = keys.where(F.col("m") > F.col("top.m"))  # a band within one component has nothing left to test
        blocks = lambda m, w: F.greatest(F.ceil(m / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
        top, rest = blocks(F.col("top.m"), F.col("top.w")), blocks(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w"))
        keys = keys.select("key", F.col("top.label").alias("top"), top.alias("tops"), rest.alias("rests"), blocks(F.col("m"), F.col("w")).alias("all"))
        rows = rows.drop("n").join(keys, "key")
        own = F.pmod(F.xxhash64("cid"), F.when(F.col("label") == F.col("top"), F.col("tops")).otherwise(F.col("rests"))).cast("int")
        place = lambda i, j, side: F.struct(i.alias("bi"), j.alias("bj"), side.cast("int").alias("side"))
        each_rest = F.sequence(F.lit(0), F.col("rests") - 1)
        of_top = F.transform(each_rest, lambda r: place(F.col("own"), -1 - r, F.lit(0)))
        of_rest = F.concat(
            F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda t: place(t, -1 - F.col("own"), F.lit(1))),
            F.transform(each_rest, lambda r: place(F.least(r, F.col("own")), F.greatest(r, F.col("own")), F.col("own") > r)),
        )
        rows = rows.withColumn("own", own).withColumn("places", F.when(F.col("all") == 1, alone).when(F.col("label") == F.col("top"), of_top).otherwise(of_rest))
    carried = rows.select("key", "band", "cid", "size", "label", "places").join(info, "cid")
    large = lambda c: F.when(F.col("size") > LARGE, F.col(c))
    placed = carried.select("key", F.explode("places").alias("p"), "cid", "label", "n", F.coalesce(large("u"), F.lit(0)).cast("long").alias("u"), "band", "keys", "sketch", large("full").alias("full"))
    placed = placed.select("key", "p.bi", "p.bj", "p.side", "cid", "label", "n", "u", "band", "keys", "sketch", "full")
    return placed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(trimmed(_compare(star, by)), "a long, b long").distinct()


def _hub_links(members: DataFrame, info: DataFrame, by: Measure) -> DataFrame | None:
    """Links (a, b), verified, of members of large bands with the hub of one of their bands; None without large bands.

    The hub of a band is the member with the greatest sum of sizes of large
    bands: edits take a copy out of bands, so the text that the others were
    made from stays in most. Hubs are laid out once for each ``HUB_ROWS``
    members of a band, so that no task holds all that meet one hub.
    """
    left = members.where(F.col("size") > LARGE).select("key", "cid")
    sets = info.select("cid", "n", "sketch", "full")
    links = None
    for _ in range(HUB_ROUNDS):
        sized = written(left.join(left.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"))
        if not sized.limit(1).count():
            break
        degree = sized.groupBy("cid").agg(F.sum("m").alias("degree"))
        hubs = sized.join(degree, "cid").groupBy("key").agg(F.max(F.struct("degree", "cid")).alias("h"))
        met = sized.join(hubs, "key").groupBy("cid").agg(F.max(F.struct(F.col("h.degree").alias("degree"), F.col("h.cid").alias("hub"), "key", "m")).alias("h"))
        groups = F.ceil(F.col("m") / HUB_ROWS).cast("int")
        pairs = met.select("cid", "h.*").where("cid <> hub").withColumn("salt", F.pmod(F.xxhash64("cid"), groups).cast("int"))
        own = pairs.select("key", "salt", "cid").join(sets, "cid")
        laid = pairs.groupBy("key", "salt").agg(F.first("hub").alias("hub")).join(sets.select(*[F.col(c).alias("hub" if c == "cid" else f"h_{c}") for c in sets.columns]), "hub")
        both = own.join(laid, ["key", "salt"]).select("cid", "hub", "n", "h_n", "sketch", "h_sketch", "full", "h_full")
        found = written(both.mapInArrow(trimmed(_hub_test(by)), "a long, b long"))
        links = found if links is None else links.unionByName(found)
        reached = found.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        left = sized.select("key", "cid").join(reached, "cid", "left_anti")
    return links


def _hub_test(by: Measure):
    """(a, hub, their sizes, sketches, sets) to the links."""
    steps = least_matches(by.num / by.den, hashes=by.hashes, step=by.step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m = t.column(2).to_numpy(), t.column(3).to_numpy()
            alive = np.arange(len(n))
            same = np.zeros(len(n), np.int32)
            x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint8).reshape(-1, by.hashes) for k in (4, 5))
            before = 0
            for upto, least in steps:
                same[alive] += (x[alive, before:upto] == y[alive, before:upto]).sum(1)
                alive, before = alive[same[alive] >= least], upto
            ok = [k for k in alive.tolist() if _linked(np.frombuffer(t.column(6)[k].as_py(), "<u8"), np.frombuffer(t.column(7)[k].as_py(), "<u8"), by)]
            yield t.take(pa.array(ok, pa.int64())).select([0, 1]).rename_columns(["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, by: Measure) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return (by.num + by.den) * int((both[1:] == both[:-1]).sum()) >= by.num * len(both)


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, by: Measure = OP3) -> DataFrame:
    """The pairs that hold on full sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = written(_sets_of(docs, reps.join(ends, "cid", "left_semi"), by))
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return written(both.where((by.num + by.den) * common >= by.num * (F.size("sa") + F.size("sb"))).select("a", "b").distinct())


def _unshared(docs: DataFrame, reps: DataFrame, members: DataFrame, by: Measure = OP3) -> DataFrame:
    """Of classes in large bands: (cid, u, full), the number of shingles that no other such class has, and the packed set."""
    wanted = reps.join(members.where(F.col("size") > LARGE).select("cid").distinct(), "cid", "left_semi")
    sets = written(_sets_of(docs, wanted, by).dropDuplicates(["cid"]))
    held = sets.select("cid", F.explode("s").alias("x")).groupBy("x").agg(F.min("cid").alias("cid"), F.max("cid").alias("last"))
    return sets.select("cid", "full").join(held.where("cid = last").groupBy("cid").agg(F.count("*").alias("u")), "cid", "left")


def described(docs: DataFrame, by: Measure = OP3) -> DataFrame:
    """Per document, in a written table: row, doc_id, th (hash of the text), n, digest, component (a class or null), component_id."""
    rows = written(_keyed(docs).mapInArrow(trimmed(partial(_describe, by=by)), f"doc_id {_keyed(docs).schema['doc_id'].dataType.simpleString()}, th long, n long, digest binary, sketch binary, bands array<long>, keys binary").withColumn("row", F.monotonically_increasing_id()))
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("cid"), F.min("doc_id").alias("least_doc"))
    classes = written(classes)
    reps = written(rows.join(classes.select(F.col("cid").alias("row")), "row", "left_semi").withColumnRenamed("row", "cid").drop("digest"))
    bands = reps.select("cid", F.posexplode("bands").alias("band", "key"))
    counts = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(bands.join(counts, "key").select("key", "band", "cid", "size"))
    u = _unshared(docs, reps, members, by)
    busy = reps.join(members.select("cid").distinct(), "cid", "left_semi")
    info = written(busy.join(u, "cid", "left").select("cid", "n", F.coalesce("u", F.lit(0)).cast("long").alias("u"), "keys", "sketch", "full"))
    none = info.sparkSession.createDataFrame([], "v long, label long")
    small = members.where((F.col("band") < STAR_BANDS) & (F.col("size") <= LARGE))
    first = _verified(docs, reps, written(_candidate_pairs(small, info, none, star=True, by=by)), by)
    hubs = _hub_links(members, info, by)
    labels = components(first if hubs is None else first.unionByName(hubs))
    second = _verified(docs, reps, written(_candidate_pairs(members, info, labels, star=False, by=by)), by)
    # The second round's links join components of the first, so these are the vertices now.
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label"))
    joined = second.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(joined.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct())
    top = over.select(F.col("v").alias("label"), F.col("label").alias("top"))
    alone = over.join(labels, "v", "left_anti")
    labels = labels.join(top, "label", "left").select("v", F.coalesce("top", "label").alias("label")).unionByName(alone)
    owned = classes.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("component", F.coalesce("label", "cid"))
    least = owned.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    named = owned.join(least, "component").select("digest", "component", "component_id")
    return rows.select("row", "doc_id", "th", "n", "digest").join(named, "digest", "left")


def report(docs: DataFrame, by: Measure = OP3) -> DataFrame:
    of = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return described(docs, by).select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"), F.col("doc_id").eqNullSafe(of).alias("kept"))


def deduplicate(docs: DataFrame, by: Measure = OP3) -> DataFrame:
    """One document of each group, in the input's columns: the one of least id, and of equal ids one row."""
    rows = written(described(docs, by))
    lonely = rows.where("n = 0")
    best = rows.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select(F.col("best.row").alias("row"))
    keep = rows.join(best, "row", "left_semi").select("doc_id", "th").unionByName(lonely.select("doc_id", "th"))
    # Rows equal in id and text can't be told apart by key; where the table has such rows, one of each stays.
    i, t, h = free_names(docs, 3)
    named = lambda df: df.select(F.col("doc_id").alias(i), F.col("th").alias(t))
    keep = named(keep.distinct())
    repeats = written(named(rows.groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1")))
    doc_id = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.col("doc_id")
    same = doc_id.eqNullSafe(F.col(i)) & F.col(h).eqNullSafe(F.col(t))
    kept = docs.withColumn(h, F.xxhash64(F.col("text").cast("string"))).join(keep, same, "left_semi")
    if repeats.limit(1).count() == 0:
        return kept.select(*docs.columns)
    once = kept.join(repeats, same, "left_anti").unionByName(kept.join(repeats, same, "left_semi").dropDuplicates(["doc_id", h]))
    return once.select(*docs.columns)
