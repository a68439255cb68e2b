"""The jobs as queries: each runs twice into one new folder and returns its whole output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardloom.queries import PERSONAL_SQL, SECRETS_SQL
from cardloom.sources.scratch import folder

from . import fold_access, ingest_cards
from .common import config


def job1_ingest_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark)
    for _ in range(2):  # a pattern, since a stream's path may be a folder but not a file
        ingest_cards.run(spark, f"{sf_dir}/documents.parquet*", f"{out}/cards", f"{out}/checkpoint")
    return ingest_cards.read(spark, f"{out}/cards")


def job2_fold_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark)
    for _ in range(2):
        fold_access.run(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/documents.parquet", out)
    return fold_access.read(spark, out)


_LINES = r"list_filter(list_transform(split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
#: Documents as the jobs see them: lines trimmed, repeats and empty ones gone.
_NORMAL = f"norm AS (SELECT doc_id, coalesce(source, 'global') AS store, array_to_string(list_filter(l, lambda x, i: list_position(k, lower(x)) = i), chr(10)) AS text FROM (SELECT doc_id, source, l, list_transform(l, lambda x: lower(x)) AS k FROM (SELECT doc_id, source, {_LINES} AS l FROM documents)))"
_KIND = "CASE WHEN regexp_matches({0}, '(?i)prefer|always|from now on|going forward') THEN 'preference' ELSE 'fact' END"
_I, _F = config("ingest_cards"), config("fold_access")
_DENIED = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w.lower()}') THEN 'rule:never:{w}' END" for w in _I["deny"]) + "], lambda x: x IS NOT NULL)"

INGEST_CARDS = f"""WITH {_NORMAL}, {PERSONAL_SQL.replace("FROM documents", "FROM norm")},
gated AS (SELECT *, {SECRETS_SQL} AS s, {_DENIED} AS n FROM pii),
judged AS (SELECT doc_id, store, t3, hits, s, n, CASE WHEN text = '' THEN 'empty' WHEN strlen(text) > {_I["most_bytes"]} THEN 'too-long' WHEN len(s) + len(n) > 0 THEN 'block' ELSE 'add' END AS op FROM gated),
ranked AS (SELECT *, CASE WHEN op = 'add' THEN row_number() OVER (PARTITION BY store, t3, op ORDER BY doc_id) ELSE 1 END AS r FROM judged)
SELECT doc_id AS seq, store, CASE WHEN r > 1 THEN 'duplicate' ELSE op END AS op, CASE WHEN op = 'add' AND r = 1 THEN {_KIND.format("t3")} END AS kind,
  CASE WHEN op = 'add' AND r = 1 THEN split(t3, chr(10))[1] END AS title, CASE WHEN op = 'add' AND r = 1 THEN sha1(t3) END AS digest,
  CASE WHEN op = 'block' THEN array_to_string(CASE WHEN len(s) > 0 THEN s ELSE n END, ',') WHEN op = 'add' AND r = 1 THEN array_to_string(hits, ',') ELSE '' END AS detail FROM ranked"""

_KEEP = "CASE kind " + " ".join(f"WHEN '{k}' THEN {float(d)}" for k, d in _F["retention_days"].items()) + " END"
FOLD_ACCESS = f"""WITH {_NORMAL}, access AS (SELECT CAST(ts AS DATE) AS day, CAST(json_extract(props, '$.k') AS BIGINT) AS card, CAST(user_id AS VARCHAR) AS session, count(*) AS n, max(ts) AS last_ts FROM events WHERE ts IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL GROUP BY ALL),
uses AS (SELECT card, sum(n) AS accesses, count(DISTINCT session) AS sessions, max(last_ts) AS last_ts FROM access GROUP BY card), clock AS (SELECT max(last_ts) AS clock FROM access),
known AS (SELECT doc_id AS card, store, {_KIND.format("text")} AS kind FROM norm)
SELECT 'state' AS part, card, store, kind, NULL AS session, NULL::DATE AS day, coalesce(accesses, 0)::BIGINT AS n, coalesce(sessions, 0) AS sessions, last_ts,
  CASE WHEN coalesce(sessions, 0) >= {_F["promote_sessions"]} THEN 'promoted' WHEN last_ts IS NULL OR (epoch_us(clock) - epoch_us(last_ts)) / 8.64e10 > {_KEEP} THEN 'archived' ELSE 'live' END AS status FROM known LEFT JOIN uses USING (card), clock
UNION ALL SELECT 'access', card, NULL, NULL, session, day, n, NULL, last_ts, NULL FROM access"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_ingest_cards, job2_fold_access)}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest_cards": INGEST_CARDS, "job2_fold_access": FOLD_ACCESS}
