"""Ranked recall: BM25 by store, tag boost, composite score, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score
from ..functions.text import snippet, tokenize
from ..sources.scratch import written
from .similarity import with_tokens


def doc_freq(cards: DataFrame) -> DataFrame:
    """Documents of each store that hold a term."""
    return cards.select("store", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("store", "term").agg(F.count("*").alias("df"))


def corpus_stats(cards: DataFrame) -> DataFrame:
    return cards.groupBy("store").agg(F.count("*").alias("doc_count"), F.avg(F.size("tokens")).alias("avg_doc_len"))


def query_terms(spark, query: str) -> list[str]:
    """The query's distinct tokens; one row on the driver, by the same function as the cards."""
    return list(dict.fromkeys(spark.createDataFrame([(query,)], "q string").select(tokenize(F.col("q"))).first()[0]))


#: What ranking never looks at; a card's texts are read again for the hits alone.
HEAVY = ("tokens", "title", "body", "text")


def measured(cards: DataFrame, terms: list[str], *, sets: bool = False) -> DataFrame:
    """``cards`` (with tokens) without texts, in a written table: len, tfs (of the query's terms), boost (tags among them), set (hashes).

    The one pass over the texts: df, lengths and scores are taken from this table.
    """
    light = [c for c in cards.columns if c not in HEAVY]
    hits = cards.withColumn("hits", F.filter("tokens", lambda x: x.isin(*terms)) if terms else F.array().cast("array<string>"))
    tfs = F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda x: x == t)).alias("tf")))
    boost = F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t).isin(*terms))) if terms and "tags" in cards.columns else F.lit(0)
    more = [hashes(F.col("tokens")).alias("set")] if sets else []
    return written(hits.select(*light, F.size("tokens").alias("len"), tfs.alias("tfs"), boost.alias("boost"), *more))


def hashes(tokens: F.Column) -> F.Column:
    """A card's distinct tokens as 64-bit hashes."""
    return F.transform(F.array_distinct(tokens), lambda x: F.xxhash64(x))


def relevance(cards: DataFrame, terms: list[str], *, sets: bool = False) -> DataFrame:
    """``cards`` (with tokens), without their texts, and their rel: BM25 of the store plus 0.3 a tag.

    Only postings of the query's terms leave the scan; statistics of a store are
    one row, those of its terms as many as the query has.
    """
    held = measured(cards, terms, sets=sets)
    if not terms:
        return held.withColumn("rel", F.lit(0.0)).drop("tfs", "boost", "len")
    df = held.select("store", F.explode("tfs.term").alias("term")).groupBy("store", "term").agg(F.count("*").alias("df"))
    stats = held.groupBy("store").agg(F.count("*").alias("doc_count"), F.avg("len").alias("avg_doc_len"))
    stats = stats.join(df.groupBy("store").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("dfs")), "store", "left")
    term = lambda x: score.bm25_term(x["tf"], F.try_element_at("dfs", x["term"]), F.col("doc_count"), F.col("len"), F.col("avg_doc_len"))
    bm25 = F.aggregate("tfs", F.lit(0.0), lambda s, x: s + term(x))
    # A row for each store is sent to the cards, which would else meet by store in one task.
    return held.join(F.broadcast(stats), "store").withColumn("rel", bm25 + 0.3 * F.col("boost")).drop("tfs", "dfs", "doc_count", "avg_doc_len", "boost", "len")


def composed(live: DataFrame, now: F.Column) -> DataFrame:
    """``live`` (with rel) cards with a positive composite score; rel is scaled by its maximum over all stores."""
    top = live.agg(F.greatest(F.lit(0.0), F.max("rel")).alias("top"))
    scaled = F.when(F.col("top") > 0, F.col("rel") / F.col("top")).otherwise(0.0)
    full = live.crossJoin(F.broadcast(top)).withColumn("score", score.composite(scaled, F.col("importance"), score.recency(F.col("last_accessed"), now), score.strength(F.col("access_count"), F.col("updated"), now)))
    return full.where("score > 0").drop("top")


def scored(cards: DataFrame, terms: list[str], now: F.Column, *, sets: bool = False) -> DataFrame:
    return composed(relevance(cards, terms, sets=sets).where("valid_until IS NULL"), now)


#: Cards of the best scores that the ranking starts from, and those that one check can add to them.
POOL, ADDED = 256, 256


def _overlap(x: frozenset, y: frozenset) -> float:
    common = len(x & y)
    return common / (len(x) + len(y) - common) if common else 0.0


def _greedy(pool: list, k: int, weight: float) -> list[tuple]:
    """The first k of ``pool`` (store, id, score, set) as (value, row): each with the value it was chosen at."""
    left = sorted(pool, key=lambda r: (-r.score, r.store, r.id))
    sets = [frozenset(r.set) for r in left]
    most, chosen = [0.0] * len(left), []
    open_ = set(range(len(left)))
    while open_ and len(chosen) < k:
        value = {i: round(weight * left[i].score - (1 - weight) * most[i], 9) for i in open_}
        best = min(open_, key=lambda i: (-value[i], i))
        chosen.append((value[best], left[best]))
        open_.discard(best)
        for i in open_:
            most[i] = max(most[i], _overlap(sets[i], sets[best]))
    return chosen


def diverse(pool: DataFrame, k: int, weight: float = 0.3, sets: DataFrame | None = None) -> list[tuple]:
    """The first k of a greedy ranking of ``pool`` (store, id, score, set) by weight * score - (1 - weight) * greatest overlap with those chosen.

    (value, row) in order; ties go to the higher score, then store and id. The ranking
    is made from the ``POOL`` best scores and then held against all other cards in
    one pass: a card that would have been chosen in some round joins, and the ranking is
    made again, until none would. Cards whose score alone is too low for the
    last value chosen are left out of the pass unlooked at. The driver holds what
    has joined, a few hundred rows.

    With ``sets`` (store, id, set) the pool needs no sets; they are joined to what a pass looks at.
    """
    with_sets = lambda df: df if sets is None else df.join(sets, ["store", "id"], "left").withColumn("set", F.coalesce("set", F.array().cast("array<bigint>")))
    need = ["store", "id", "score", *([] if sets is not None else ["set"])]
    slim = pool.select(*need)
    start = slim.orderBy(F.col("score").desc(), "store", "id").limit(max(POOL, k))
    held = with_sets(start).collect()
    spark = pool.sparkSession
    while True:
        chosen = _greedy(held, k, weight)
        if len(held) < max(POOL, k) or not chosen:
            return chosen
        keys = spark.createDataFrame([(r.store, r.id) for r in held], "store string, id string")
        rest = slim.where(weight * F.col("score") >= min(v for v, _ in chosen) - 1e-9).join(F.broadcast(keys), ["store", "id"], "left_anti")
        overlap, margin = F.lit(0.0), F.lit(None).cast("double")
        for value, row in chosen:
            margin = F.greatest(margin, weight * F.col("score") - (1 - weight) * overlap - value)
            one = F.array(*map(F.lit, row.set)).cast("array<bigint>")
            common = F.size(F.array_intersect("set", one))
            overlap = F.greatest(overlap, F.when(common == 0, 0.0).otherwise(common / (F.size("set") + len(row.set) - common)))
        more = with_sets(rest).withColumn("margin", margin).where("margin >= -1e-9").orderBy(F.col("margin").desc(), "store", "id").limit(ADDED).collect()
        if not more:
            return chosen
        held += more


def mmr(pool: DataFrame, k: int, weight: float = 0.3) -> DataFrame:
    """The cards of ``pool`` (with tokens and score) that ``diverse`` ranks first: rank, store, id, kind, title, body, score."""
    light = written(pool.select("store", "id", "score", hashes(F.col("tokens")).alias("set")))
    return shown(pool, diverse(light, k, weight))


def shown(cards: DataFrame, chosen: list[tuple]) -> DataFrame:
    """The rows of ``cards`` that were chosen, with rank and score; k rows meet the cards by broadcast."""
    rows = [(i + 1, r.store, r.id, float(r.score)) for i, (_, r) in enumerate(chosen)]
    hits = cards.sparkSession.createDataFrame(rows, "rank int, store string, id string, score double")
    return cards.drop("score").join(F.broadcast(hits), ["store", "id"]).select("rank", "store", "id", "kind", "title", "body", "score")


def hits(cards: DataFrame, chosen: list[tuple]) -> DataFrame:
    """Hits in order: rank, store, id, kind, title, snippet, score."""
    out = shown(cards, chosen)
    return out.select("rank", "store", "id", "kind", "title", snippet(F.col("title"), F.col("body")).alias("snippet"), F.round("score", 3).alias("score")).orderBy("rank")


def recall(cards: DataFrame, query: str, now: F.Column, *, k: int = 8, stores: list[str] | None = None) -> DataFrame:
    """Ranked hits; see ``hits`` for the columns."""
    k = min(20, max(1, k))
    if stores is not None:
        cards = cards.where(F.col("store").isin(stores))
    pool = written(scored(with_tokens(cards), query_terms(cards.sparkSession, query), now, sets=True).select("store", "id", "score", "set"))
    return hits(cards, diverse(pool, k))
