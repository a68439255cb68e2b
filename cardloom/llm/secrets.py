"""Secret scan by corpus-wide ownership frequency (DataFrame functions only).

Detectors propose candidate spans in every whole text. The hash of each
candidate's value is counted over the whole corpus by distinct repositories
and distinct owners. A value that many owners carry is an example copied from
documentation; a value of one owner looks live. Base detectors always keep
their spans; the further detectors add a span only where its value is owner
specific.

Defined cases: null text is empty; null owner or repository counts as the
empty name; a repeated row yields its own output row; an empty table yields no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let, running_totals, written

# Detector name, pattern, group that holds the value, least
# length (of the value for assign, of the match for the others).
BASE_DETECTORS = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
EXTRA_DETECTORS = [
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}", 0, 27),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", 0, 40),
]
#: A value carried by more owners than this is a copied example.
MAX_OWNERS = 1
#: Hashes with at least 1/HEAVY of all candidates are joined by broadcast: there can be HEAVY of them at most.
HEAVY = 1000

_SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint,value:string>>"


def detector_spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches of one detector, as structs.

    Positions come from the lengths of the pieces between matches, in code
    points; a match that is too short is dropped after matching, without retry.
    """
    pat = F.lit(pattern)

    def build(found: Column) -> Column:
        stops = running_totals(F.zip_with(F.slice(found["gaps"], 1, F.size(found["whole"])), found["whole"], lambda g, m: (F.length(g) + F.length(m)).cast("long")))
        spans = F.zip_with(
            F.arrays_zip(found["whole"].alias("whole"), found["value"].alias("value")),
            stops,
            lambda m, stop: F.struct(
                (stop - F.length(m["whole"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), m["value"].alias("value")
            ),
        )
        return F.filter(spans, lambda s: F.length(s["value"]) >= least).cast(_SPAN)

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, pat, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pat, F.lit(group)).alias("value"),
    )
    return F.when(text.rlike(pattern), let(found, build)).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """A row per document with its spans; no text is carried further."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repository is None else repository
    text = F.col("t")
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"))
    rank = {k[0]: i for i, k in enumerate([*BASE_DETECTORS, *EXTRA_DETECTORS])}
    some = lambda ds: F.concat(*[detector_spans(text, k, rank[k], p, g, n) for k, p, g, n in ds])
    return read.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", F.array_sort(some(BASE_DETECTORS)).alias("base"), some(EXTRA_DETECTORS).alias("extra")
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: spans, distinct repositories, distinct owners.

    Three partial aggregations, so a value in a third of all rows leaves every
    map task as one row.
    """
    per_repo = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, *, max_owners: int = MAX_OWNERS, **columns) -> DataFrame:
    """A row per document: base spans, added spans, and the verdict on each.

    Returns row, doc_id, base (array of spans), judged (array of spans with
    hash, n_owners, n_repositories, live), where judged holds base spans and
    those further spans whose value is owner specific.
    """
    rows = written(candidates(docs, **columns))
    found = rows.select("row", "owner", "repository", F.explode(F.concat("base", "extra")).alias("s")).withColumn("hash", F.sha2(F.col("s.value"), 256))
    stats = written(ownership(found))
    total = stats.agg(F.sum("n_spans")).first()[0] or 0
    heavy = stats.where(F.col("n_spans") * HEAVY >= F.lit(total))
    # A heavy hash meets its figures by a broadcast of HEAVY rows at most, a light one by an ordinary join.
    judged = found.join(F.broadcast(heavy), "hash").unionByName(
        found.join(F.broadcast(heavy.select("hash")), "hash", "left_anti").join(stats.where(F.col("n_spans") * HEAVY < F.lit(total)), "hash")
    )
    live = F.col("n_owners") <= max_owners
    per_row = (
        judged.where((F.col("s.rank") < len(BASE_DETECTORS)) | live)
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.kind", "s.stop", "hash", "n_owners", "n_repositories", live.alias("live")))).alias("judged"))
    )
    return rows.select("row", "doc_id", "base").join(per_row, "row", "left")


def digest(spans: Column) -> Column:
    """kind:start:end of spans already in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns, and how many spans look live or copied."""
    n = lambda a, f: F.size(F.filter(a, f)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return scan(docs, **options).select(
        "doc_id",
        *[n(F.col("base"), of_kind(k)).alias(f"n_{k}") for k, *_ in BASE_DETECTORS],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(digest(F.col("judged")), F.lit("")).alias("spans"),
        F.coalesce(n(F.col("judged"), lambda s: s["live"]), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(n(F.col("judged"), lambda s: ~s["live"]), F.lit(0)).cast("long").alias("n_example"),
    )
