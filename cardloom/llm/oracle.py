"""DuckDB SQL for the queries whose results SQL can say over whole tables."""

from __future__ import annotations

from . import decontaminate, filters, quality, secrets

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
#: Java's white space has the vertical tab, RE2's hasn't.
_JAVA_SPACE = r"\t\n\x0B\f\r "


def _pattern(java: str) -> str:
    in_class = java.replace(r"\s]", _JAVA_SPACE + "]").replace(r"[\s", "[" + _JAVA_SPACE)
    return "'" + in_class.replace(r"\s", f"[{_JAVA_SPACE}]").replace("'", "''") + "'"


def _next(n: int, partition: str) -> str:
    return ", ".join(f"lead(w, {k}) OVER (PARTITION BY {partition} ORDER BY pos) AS w{k}" for k in range(1, n))


def _joined(n: int) -> str:
    return "concat_ws(' ', " + ", ".join(["w", *(f"w{k}" for k in range(1, n))]) + ")"


_BARE = f"regexp_replace(lower(l), {_pattern(quality.CLOSING)}, '')"
for _p, _e in quality.JOINED:
    _BARE = f"regexp_replace({_BARE}, {_pattern(_p)}, '{_e.replace('$', chr(92))}', 'g')"
_MENU = f"string_split_regex({_BARE}, {_pattern(quality.BETWEEN)})"
_FAILS = f"""(length(l) - length(regexp_replace(l, '[{quality.SYMBOLS}]', '', 'g'))) * 10 > length(l)
  OR (regexp_matches(l, '[^\\x20\\x09-\\x0D]') AND NOT regexp_matches(l, {_pattern(quality.CLOSING)}))
  OR (regexp_matches(l, {_pattern(quality.MENU_START)}) AND len(list_filter({_MENU}, lambda x: x <> '')) > 1 AND len(list_filter({_MENU}, lambda x: x NOT IN ('', {", ".join(f"'{w}'" for w in quality.NAVIGATION)}))) = 0)
  OR (length(l) <= 200 AND regexp_matches(l, {_pattern(quality.BOILERPLATE)}))
  OR (length(l) >= 20 AND length(regexp_replace(l, '\\P{{Lu}}+', '', 'g')) > 12 AND length(regexp_replace(l, '\\P{{Lu}}+', '', 'g')) * 10 > length(regexp_replace(l, '\\P{{L}}+', '', 'g')) * 6)"""

LINE_QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
judged AS (SELECT r, l, regexp_matches(l, '[^\x20\x09-\x0D]') AS full_line, {_FAILS} AS fails FROM lines),
ln AS (SELECT r, count(*) FILTER (full_line) - count(DISTINCT l) FILTER (full_line) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed,
  coalesce(sum(length(l)) FILTER (full_line), 0)::BIGINT AS line_chars, coalesce(sum(length(l)) FILTER (full_line AND NOT fails), 0)::BIGINT AS line_chars_kept FROM judged GROUP BY r),
ws AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM (SELECT r, {_WORDS.format("t")} AS x FROM d)),
sums AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM ws GROUP BY r),
three AS (SELECT r, pos, {_joined(3)} AS s FROM (SELECT *, {_next(3, "r")} FROM ws) WHERE w2 IS NOT NULL),
twice AS (SELECT r, s FROM three GROUP BY r, s HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM three SEMI JOIN twice USING (r, s)) GROUP BY r),
o AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')) AS n_symbols,
  n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines_removed, line_chars, line_chars_kept FROM d JOIN ln USING (r) LEFT JOIN sums USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND line_chars_kept >= line_chars * (1 - {quality.MAX_LOST}) AS kept FROM f"""


def _near(k: int) -> str:
    """Documents with their components by sets of k-word shingles at 0.85."""
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(_LOWER.format("text"))}, []) AS x FROM documents),
ws AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM d),
sh AS (SELECT DISTINCT r, {_joined(k)} AS s FROM (SELECT *, {_next(k, "r")}, count(*) OVER (PARTITION BY r) AS c FROM ws) WHERE w{k - 1} IS NOT NULL OR (c < {k} AND pos = 1)),
sets AS (SELECT r, list_sort(list(s)) AS s FROM sh GROUP BY r),
cls AS (SELECT min(doc_id) AS k, s, len(s) AS n FROM sets JOIN d USING (r) GROUP BY s),
e AS (SELECT k, n, unnest(s) AS s FROM cls),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.s = b.s AND a.k < b.k AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.k, b.k),
near AS (SELECT a, b FROM c WHERE 185 * c >= 85 * n),
edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT k AS a, k AS b FROM cls UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least_id AS (SELECT a AS k, min(b) AS component_id FROM reach GROUP BY a),
o AS (SELECT d.doc_id, coalesce(cls.n, 0)::BIGINT AS n_shingles, coalesce(least_id.component_id, d.doc_id) AS component_id FROM d LEFT JOIN sets USING (r) LEFT JOIN cls ON sets.s = cls.s LEFT JOIN least_id ON cls.k = least_id.k)
SELECT * FROM o"""


NEAR_DUPLICATES = f"SELECT *, doc_id = component_id AS kept FROM ({_near(3)})"
NGRAM_JOIN = _near(4)

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_N = decontaminate.WINDOW
_SPLIT = f"regexp_extract_all({_LOWER.format('text')}, '{_ITEM_WORD}')"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SPLIT}, []) AS x FROM documents),
dw AS (SELECT *, {_next(_N, "r")} FROM (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM d)),
i AS (SELECT row_number() OVER () AS r, item_id, {_SPLIT} AS x FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT *, {_next(_N, "r")} FROM (SELECT r, item_id, len(x) AS c, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM i)),
pat AS (SELECT DISTINCT item_id, least(c, {_N}) AS m, {_joined(_N)} AS s FROM iw WHERE w{_N - 1} IS NOT NULL OR (c < {_N} AND pos = 1)),
win AS ({" UNION ALL ".join(f"SELECT r, pos, {m} AS m, {_joined(m)} AS s FROM dw" + (f" WHERE w{m - 1} IS NOT NULL" if m > 1 else "") for m in range(1, _N + 1))}),
hit AS (SELECT r, pos, m, item_id FROM win JOIN pat USING (m, s)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + m)) AS p FROM (SELECT DISTINCT r, pos, m FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS v FROM (SELECT DISTINCT r, item_id::VARCHAR AS v FROM hit) GROUP BY r)
SELECT doc_id, len(x)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(v, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Row, start, rank, kind, stop and value of one detector's matches: starts come from the lengths of what lies between them."""
    p = _pattern(pattern)
    pieces = f"SELECT r, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {group}) AS val FROM d WHERE regexp_matches(t, {p})"
    each = f"SELECT r, generate_subscripts(whole, 1) AS k, unnest(gaps[:len(whole)]) AS gap, unnest(whole) AS m, unnest(val) AS v FROM ({pieces})"
    stops = f"SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY k)::BIGINT AS stop FROM ({each})"
    return f"SELECT r, stop - length(m) AS start, {rank} AS rank, '{kind}' AS kind, stop, v FROM ({stops}) WHERE length(v) >= {least}"


_KINDS = [*secrets.BASE_DETECTORS, *secrets.EXTRA_DETECTORS]
_BASE = len(secrets.BASE_DETECTORS)
_LISTED = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){0}, '')"

SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(k, i, p, g, n) for i, (k, p, g, n) in enumerate(_KINDS))}),
owned AS (SELECT v, count(DISTINCT owner) <= {secrets.MAX_OWNERS} AS live FROM s JOIN d USING (r) GROUP BY v),
per_row AS (SELECT r, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, (k, *_) in enumerate(_KINDS[:_BASE]))}, {_LISTED.format(f" FILTER (rank < {_BASE})")} AS base,
  {_LISTED.format(f" FILTER (rank < {_BASE} OR live)")} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (rank < {_BASE} AND NOT live) AS n_example FROM s JOIN owned USING (v) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in _KINDS[:_BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN per_row USING (r)"""

_STEP = "CASE substr(filter_order, {0}, 1) " + " ".join(f"WHEN '{c}' THEN {1 << k}" for k, c in enumerate(filters.NAMES)) + " ELSE 0 END"

FILTER_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < {filters.MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {filters.MIN_DISTINCT} * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filters.MAX_CAPITALS} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '{filters.SYMBOLS}') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(string_split('{filters.NAMES}', '')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step::INTEGER AS step, {_STEP.format("step")} AS bit, ({" + ".join(f"CASE WHEN step > {k} THEN {_STEP.format(k)} ELSE 0 END" for k in range(1, 5))}) AS before FROM o, range(1, 6) r(step)),
p AS (SELECT c.*, s.*, (mask & bit) > 0 AS here, (mask & before) = 0 AS alive FROM c, s),
g AS (SELECT part, filter_order, step, any_value(bit) AS bit, coalesce(sum(n) FILTER (alive AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (alive AND here), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (NOT alive AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (alive AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (alive AND here), 0)::BIGINT AS toxic_lost FROM p GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM g"""
