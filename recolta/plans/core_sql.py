"""DuckDB SQL of the core queries, written independently of the Spark expressions."""

from __future__ import annotations

NOW = "TIMESTAMPTZ '2026-07-01 00:00:00+00'"
PLAT = lambda c="platform": f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'unknown' ELSE lower(trim({c})) END"
STAMP = lambda c: f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f')"
AGE = f"greatest(0, (epoch_us({NOW}) - epoch_us(captured_at)) / 86400000000.0)"
TAG = lambda t: f"list_contains(list_transform(tags, lambda x: lower(x)), '{t}')"
WORDS = lambda c: f"regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+')"
COLLAPSE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
CLIP = lambda c, n: f"CASE WHEN length({COLLAPSE(c)}) > {n} THEN rtrim(substr({COLLAPSE(c)}, 1, {n - 3})) || '...' ELSE {COLLAPSE(c)} END"
#: Words of the full-text index: no diacritics, captions as one text.
INDEXED = "list_concat(list_concat({}, {}), {})".format(*[f"regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+')" for c in ("text_content", "array_to_string(image_captions, ' ')", "author")])
FIRST_WORDS = lambda c, n: f"array_to_string(string_split({COLLAPSE(c)}, ' ')[1:{n}], ' ')"
LOW = "lower(coalesce(text_content, ''))"
HEAT = "CASE WHEN heat IS NULL OR heat = 0 THEN 1.0 ELSE heat END"
CONF = "CASE WHEN capture_confidence IS NULL OR capture_confidence = 0 THEN 1.0 ELSE capture_confidence END"
UNIT = lambda e: f"greatest(0.0, least(1.0, {e}))"
HIT = lambda c, p: f"regexp_matches({c}, '{p}')"

_NOISE = [
    (f"length(trim({LOW})) < 18", "low_information_content", 0.35),
    (HIT(LOW, r"\b(like\s+and\s+subscribe|follow\s+for\s+more|comment\s+below|tag\s+\d+\s+friends)\b"), "engagement_bait", 0.25),
    (HIT(LOW, r"(free\s+money|crypto\s+giveaway|airdrop|dm\s+me\s+now)"), "spam_like_content", 0.35),
    (HIT(LOW, r"\b(repost|retweet|shared\s+from|via\s+@)\b"), "repetitive_repost", 0.2),
    (f"({HIT(LOW, r'\b(meme|template|reaction|shitpost)\b')} AND length({LOW}) < 120)", "duplicate_meme_variant", 0.18),
    ("coalesce(len(image_urls), 0) > 3", "high_link_density", 0.1),
]
NOISE = UNIT(" + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, _, w in _NOISE))
NOISE_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in _NOISE) + " END"

ENRICHED = f"""
WITH m AS (SELECT *, {AGE} AS age, CASE WHEN {TAG('fact')} THEN 'fact' WHEN {TAG('preference')} THEN 'preference' WHEN {TAG('task')} OR {LOW} LIKE '%todo%' THEN 'task' WHEN {TAG('intent')} THEN 'intent' WHEN lower(content_type) IN ('video', 'image') THEN 'episode' ELSE 'ephemeral' END AS memory_type FROM items),
d AS (SELECT *, round({UNIT(f"1 - pow(2.0, -age / greatest(7.0, 90.0 * ((1.0 + least(1.5, coalesce(surfaced_count, 0) * 0.06) + CASE WHEN {HEAT} >= 2.5 OR coalesce(starred, false) THEN 0.7 ELSE 0 END) * CASE memory_type WHEN 'fact' THEN 1.8 WHEN 'preference' THEN 1.4 WHEN 'task' THEN 1.1 WHEN 'intent' THEN 1.0 WHEN 'episode' THEN 0.85 ELSE 0.75 END)))")}, 6) AS decay_score, {NOISE} AS noise_score FROM m),
q AS (SELECT *, CASE WHEN archived_at IS NOT NULL THEN 'archived' WHEN decay_score >= 0.85 THEN 'stale' WHEN decay_score >= 0.45 THEN 'cooling' ELSE 'active' END AS aging_state,
  greatest(0.0, 1.0 - least(1.0, age / 365.0)) AS recency, {UNIT("coalesce(surfaced_count, 0) / 10.0")} AS recurrence,
  {UNIT(f"{UNIT(CONF)} * 0.62 + greatest(0.0, 1.0 - least(1.0, age / 365.0)) * 0.2 + least(0.35, ({HEAT}) * 0.08) + CASE WHEN starred THEN 0.18 ELSE 0 END - least(0.35, decay_score * 0.25)")} AS importance FROM d)
"""


def _action(state: str) -> str:
    return f"CASE WHEN {state} = 'forgotten' THEN 'purged' WHEN decay_score >= 0.97 THEN 'forget' WHEN decay_score >= 0.85 THEN 'archive' WHEN decay_score >= 0.45 THEN 'review' ELSE 'retain' END"


def _feed(mode: str) -> str:
    technical = " OR ".join(f"{LOW} LIKE '%{t}%'" for t in ("api", "docker", "kubernetes", "database", "architecture", "python", "typescript"))
    bonus = {"default": "0", "focus": f"CASE WHEN content_type IN ('article', 'post') AND ({technical}) THEN 0.2 ELSE 0.05 END", "light": "CASE WHEN content_type IN ('video', 'image') THEN 0.18 ELSE 0 END", "explore": "greatest(0, 0.16 - ln(1 + coalesce(surfaced_count, 0)) * 0.04)"}[mode]
    h = f"greatest(0.05, {HEAT})"
    return ENRICHED + f""", f AS (SELECT * FROM q WHERE coalesce(namespace, 'default') = 'default' AND archived_at IS NULL ORDER BY heat DESC, captured_at DESC, id LIMIT 240)
SELECT id, {PLAT()} AS platform, heat, substr(trim(coalesce(text_content, '')), 1, 220) AS text_excerpt,
 round({h} * 0.68 + 0.2 / (1 + age / 14.0) + least(0.25, coalesce(dwell_seconds, 0) / 120.0) + CASE WHEN starred THEN 0.45 ELSE 0 END + CASE WHEN age >= 14 THEN 0.18 ELSE 0 END + {bonus} - least(0.45, decay_score * 0.4) - least(0.35, noise_score * 0.35), 6) AS score,
 CASE WHEN age >= 30 THEN 'review_or_archive' WHEN age >= 14 THEN 'worth_resurfacing' WHEN starred THEN 'starred_memory' WHEN age < 2 THEN 'recent_capture' ELSE 'hot_memory' END AS surface_reason, age >= 30 AND {h} < 0.8 AS needs_review
FROM f ORDER BY score DESC, id LIMIT 20"""


def _bm25(terms: list[str], fields: str) -> str:
    n = range(len(terms))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in n)
    return f"""t AS (SELECT id, archived_at, namespace, starred, text_content, list_filter({fields}, lambda x: x <> '') AS w FROM items),
c AS (SELECT *, len(w) AS l, {tf} FROM t), s AS (SELECT count(*) AS n, avg(l) AS a, {", ".join(f"count_if(f{i} > 0) AS d{i}" for i in n)} FROM c),
h AS (SELECT c.*, round({score}, 6) AS bm25 FROM c, s WHERE {" AND ".join(f"f{i} > 0" for i in n)})"""


def _ranked(query: str) -> str:
    return f"SELECT '{query}' AS query, row_number() OVER (ORDER BY bm25 DESC, id) AS rank, starred, text_content AS text FROM (WITH {_bm25(query.split(), WORDS('text_content'))} SELECT * FROM h ORDER BY bm25 DESC, id LIMIT 10)"


_VALID = "WITH v AS (SELECT * FROM memory_nodes WHERE memory_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, state DESC NULLS LAST, decay_score DESC NULLS LAST, reinforcement DESC NULLS LAST, importance_score DESC NULLS LAST) = 1), n AS (SELECT * FROM v WHERE coalesce(namespace, 'default') = 'default')"
_FIRST = "WITH ev AS (SELECT event_id, arg_min(memory_id, created_at) AS memory_id, arg_min(event_type, created_at) AS event_type, min(created_at) AS created_at, arg_min(CASE WHEN json_valid(payload) THEN try_cast(json_extract_string(payload, '$.amount') AS DOUBLE) END, created_at) AS amount FROM (SELECT DISTINCT event_id, memory_id, event_type, payload, created_at FROM memory_events) GROUP BY event_id)"
_STATES = "CASE event_type WHEN 'capture' THEN 'captured' WHEN 'normalize' THEN 'normalized' WHEN 'summarize' THEN 'summarized' WHEN 'index' THEN 'indexed' WHEN 'reinforce' THEN 'reinforced' WHEN 'decay' THEN 'decaying' WHEN 'archive' THEN 'archived' WHEN 'forget' THEN 'forgotten' END"
_ANY = lambda words: " OR ".join(f"{LOW} LIKE '%{w}%'" for w in words)
_CASES = [("checklist", "recall", ["checklist", "itinerary"]), ("bakery", "recall", ["zeppelin"]), ("memory", "consistency", ["long thread about memory"]), ("stale", "staleness", ["old laptop"]), ("contra", "contradiction", ["unpopular opinion"])]
_HITS = " UNION ALL ".join(f"SELECT '{n}' AS \"case\", '{k}' AS kind, count_if({_ANY(w)}) AS hits FROM items" for n, k, w in _CASES)
_FOUND = lambda w: f"(SELECT count(*) > 0 FROM items WHERE {LOW} LIKE '%{w}%')"
_MISSING = "len(list_filter(quality_flags, lambda f: f LIKE 'missing~_%' ESCAPE '~')) > 0"
_EMAIL, _KEY, _BEARER = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"(?i)\b(?:sk|rk|pk|api|key)[_-]?[A-Za-z0-9]{16,}\b", r"(?i)\bBearer\s+[A-Za-z0-9._\-+/=]{16,}\b"
_TOPICS = "list_filter(list_transform(regexp_extract_all(coalesce(text_content, ''), '[A-Za-z][A-Za-z0-9_#@-]{2,}'), lambda x: lower(x)), lambda x: length(x) >= 4 AND x NOT IN ('this','that','with','from','have','will','about','there','would','could','should','their','because','while','where'))"
_DISTINCT = lambda e, n: f"list_transform(list_sort(list_transform(list_distinct({e}), lambda x: {{'p': list_position({e}, x), 'x': x}})), lambda s: s.x)[1:{n}]"

SQL: dict[str, str] = {
    "list_items": f"SELECT id, platform, {STAMP('captured_at')} AS captured_at FROM items WHERE coalesce(namespace, 'default') = 'default' AND {PLAT()} = 'twitter' ORDER BY items.captured_at DESC, id LIMIT 50 OFFSET 10",
    "point_lookup": "SELECT id, url, author FROM items WHERE id = (SELECT max(id) FROM items)",
    "multi_get": "SELECT id, platform, author FROM items WHERE id IN (SELECT item_id FROM memory_nodes WHERE state = 'forgotten')",
    "timeline_day": f"SELECT id, {STAMP('captured_at')} AS captured_at, platform FROM items WHERE captured_at >= TIMESTAMPTZ '2026-03-10 00:00:00+00' AND captured_at < TIMESTAMPTZ '2026-03-11 00:00:00+00'",
    "hour_groups": "SELECT hour(captured_at AT TIME ZONE 'UTC') AS hour, count(*) AS items, arg_min(id, (captured_at, id)) AS first_id, arg_max(id, (captured_at, id)) AS last_id FROM items WHERE captured_at >= TIMESTAMPTZ '2026-03-10 00:00:00+00' AND captured_at < TIMESTAMPTZ '2026-03-11 00:00:00+00' GROUP BY 1",
    "bm25_search": f"WITH {_bm25(['release', 'notes'], INDEXED)} SELECT id, bm25 FROM h WHERE archived_at IS NULL AND coalesce(namespace, 'default') = 'default' ORDER BY bm25 DESC, id LIMIT 50",
    "phrase_search": f"WITH t AS (SELECT id, list_filter({WORDS('text_content')}, lambda x: x <> '') AS w FROM items), h AS (SELECT id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'release' AND w[i + 1] = 'notes')) AS hits FROM t) SELECT * FROM h WHERE hits > 0",
    "postings_stats": f"WITH t AS (SELECT id, unnest({WORDS('text_content')}) AS term FROM items) SELECT term, count(DISTINCT id) AS docs, count(*) AS hits FROM t WHERE term <> '' GROUP BY term",
    "vector_knn": "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))) AS d FROM embeddings, q) ORDER BY d, vec_id LIMIT 20",
    "cosine_by_label": "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT label, round(avg(list_sum(list_transform(list_zip(embedding, e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))), 6) AS mean_cosine, count(*) AS vectors FROM embeddings, q GROUP BY label",
    "rrf_fusion": "WITH a AS (SELECT id, row_number() OVER (ORDER BY heat DESC, id) AS r FROM items QUALIFY r <= 40), b AS (SELECT id, row_number() OVER (ORDER BY dwell_seconds DESC, id) AS r FROM items QUALIFY r <= 40), f AS (SELECT coalesce(a.id, b.id) AS id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS s, a.r AS ar, b.r AS br FROM a FULL JOIN b ON a.id = b.id), k AS (SELECT *, row_number() OVER (ORDER BY s DESC, ar NULLS LAST, br NULLS LAST, id) AS rank FROM f) SELECT id, round(s, 8) AS rrf, rank FROM k WHERE rank <= 30",
    "diversity_rerank": f"WITH f AS (SELECT DISTINCT id, {PLAT()} AS platform, coalesce(cluster_id, '') AS cluster, score FROM feed_items ORDER BY score DESC, id, cluster, platform LIMIT 200), p AS (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY score DESC, id) - 1) * 0.3::DOUBLE + (row_number() OVER (PARTITION BY platform ORDER BY score DESC, id) - 1) * (0.3::DOUBLE * 0.35::DOUBLE) AS pen FROM f) SELECT id, round(score - pen, 8) AS score, round(pen, 6) AS diversity_penalty FROM p",
    "decay_states": ENRICHED + f"SELECT id, memory_type, decay_score, aging_state, {_action('aging_state')} AS next_action FROM q",
    "ranking_primitives": ENRICHED + f"SELECT id, round(importance, 6) AS importance_score, round({UNIT('recency * 0.35 + recurrence * 0.45 + importance * 0.2')}, 6) AS resurfacing_score, round(recency, 6) AS recency_score, round(recurrence, 6) AS recurrence_score FROM q",
    "auto_archive": ENRICHED + "SELECT id, 'retention:auto_archive:90d' AS archive_reason FROM q WHERE age >= 90 AND round(importance, 6) <= 0.6",
    "heat_decay": f"SELECT id, round(CASE WHEN archived_at IS NULL AND captured_at < {NOW} - INTERVAL 7 DAY THEN greatest(0.05, heat * 0.95) ELSE heat END, 6) AS heat FROM items",
    "additive_rank": ENRICHED + f"SELECT id, round(0.9 + recency * 0.25 + least(0.35, ({HEAT}) * 0.05) - 0.12 - least(0.4, noise_score * 0.5) - CASE WHEN {CONF} >= 0.55 THEN 0 ELSE (0.55 - {CONF}) * 0.6 END, 8) AS rank_score FROM q",
    "noise": f"SELECT id, round(({NOISE})::DOUBLE, 6) AS noise_score, {NOISE_REASON} AS noise_reason FROM items",
    "sanitize": r"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\bignore\s+(all|previous)\s+instructions\b', '[SANITIZED_INSTRUCTION]', 'g'), '(?i)\breveal\s+(secrets?|credentials?)\b', '[SANITIZED_SECRET_REQUEST]', 'g') AS clean FROM documents",
    "topics": f"WITH t AS (SELECT id, {_TOPICS} AS tp FROM items) SELECT id, array_to_string({_DISTINCT('tp', 8)}, ',') AS topics FROM t",
    "clip_summaries": f"SELECT doc_id, {CLIP('text', 180)} AS short, {CLIP('text', 420)} AS medium, {FIRST_WORDS('text', 140)} AS words FROM documents",
    "fingerprints": "SELECT id, (epoch_us(captured_at) // 7200000000)::VARCHAR AS bucket, sha256(coalesce(canonical_url, '') || '|' || coalesce(platform, '') || '|' || substr(coalesce(text_content, ''), 1, 240) || '|' || substr(coalesce(author_name, ''), 1, 100) || '|' || (epoch_us(captured_at) // 7200000000)::VARCHAR) AS fingerprint FROM items",
    "keep_first": "SELECT dedupe_key, arg_min(id, (captured_at, id)) AS id FROM items WHERE dedupe_key IS NOT NULL GROUP BY dedupe_key",
    "insert_ignore": "WITH o AS (SELECT dedupe_key, arg_min(id, (captured_at, id)) AS s FROM items WHERE captured_at < TIMESTAMPTZ '2026-04-01 00:00:00+00' AND dedupe_key IS NOT NULL GROUP BY 1), n AS (SELECT * FROM items WHERE captured_at >= TIMESTAMPTZ '2026-04-01 00:00:00+00'), f AS (SELECT dedupe_key, arg_min(id, (captured_at, id)) AS f FROM n WHERE dedupe_key IS NOT NULL GROUP BY 1), m AS (SELECT n.id, s, f, s IS NULL AND (f IS NULL OR f = n.id) AS inserted FROM n LEFT JOIN o USING (dedupe_key) LEFT JOIN f USING (dedupe_key)) SELECT inserted, count(*) AS rows, count(DISTINCT CASE WHEN NOT inserted THEN coalesce(s, f) END) AS existing FROM m GROUP BY inserted",
    "patch_items": "WITH p AS (SELECT item_id AS id, min(importance_score) AS h, max(namespace) AS n FROM memory_nodes GROUP BY 1) SELECT i.id, coalesce(h, heat) AS heat, coalesce(n, namespace) AS namespace, author FROM items i LEFT JOIN p USING (id)",
    "bump_heat": "WITH b AS (SELECT id, sum(recency_score + 0.1) AS a FROM feed_items GROUP BY id) SELECT i.id, round(CASE WHEN a IS NULL THEN heat ELSE least(10.0, coalesce(heat, 1.0) + a) END, 6) AS heat FROM items i LEFT JOIN b USING (id)",
    "mark_surfaced": "WITH b AS (SELECT DISTINCT id, true AS hit FROM feed_items WHERE starred) SELECT i.id, round(CASE WHEN hit THEN least(10.0, coalesce(heat, 1.0) + 0.05) ELSE heat END, 6) AS heat, CASE WHEN hit THEN coalesce(surfaced_count, 0) + 1 ELSE surfaced_count END AS surfaced_count FROM items i LEFT JOIN b USING (id)",
    "stats_overview": f"WITH s AS (SELECT count(*) AS total, count_if((captured_at AT TIME ZONE 'UTC')::DATE = DATE '2026-03-10') AS today, count_if(starred) AS starred, count_if(coalesce(capture_confidence, 1) < 0.7) AS low_confidence, count_if({_MISSING}) AS missing_required FROM items WHERE coalesce(namespace, 'default') = 'default') SELECT *, round(greatest(0, 1 - (low_confidence + missing_required) / greatest(1, total)), 4) AS health_score FROM s",
    "by_platform": f"SELECT {PLAT()} AS platform, count(*) AS items FROM items GROUP BY 1",
    "by_type": "SELECT content_type, count(*) AS items FROM items GROUP BY 1",
    "reliability": f"WITH m AS (SELECT {PLAT()} AS platform, count(*) AS a, count_if(capture_confidence > 0.5) AS s, count_if(surfaced_count > 3) AS d, count_if({_MISSING}) AS m FROM items GROUP BY 1) SELECT platform, a AS attempts, round(s / a, 4) AS success_rate, round(greatest(0, a - s - d) / a, 4) AS fail_rate, round(d / a, 4) AS duplicate_rate, round(m / a, 4) AS missing_rate FROM m",
    "dashboard": f"SELECT round(avg({CONF}), 6) AS mean_confidence, round(avg(CASE WHEN json_valid(capture_debug) AND json_extract_string(capture_debug, '$.selector') = 'fallback' THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate, round(avg(CASE WHEN {_MISSING} THEN 1.0 ELSE 0.0 END), 6) AS missing_rate, round(avg(CASE WHEN list_contains(quality_flags, 'duplicate_risk') THEN 1.0 ELSE 0.0 END), 6) AS duplicate_rate FROM items",
    "recall_eval": f"SELECT *, hits > 0 AS hit FROM ({_HITS})",
    "evaluation": f"SELECT {', '.join(f'round(count_if(kind = {chr(39)}{k}{chr(39)} AND hits > 0) / greatest(1, count_if(kind = {chr(39)}{k}{chr(39)})), 6) AS {k}' for k in ('recall', 'consistency', 'staleness', 'contradiction'))} FROM ({_HITS})",
    "failure_cases": f"SELECT 'found' AS \"case\", {_FOUND('release notes')} AND {_FOUND('train schedule')} AND NOT {_FOUND('zeppelin')} AS passed UNION ALL SELECT 'banned', {_FOUND('release notes')} AND NOT {_FOUND('coffee')} UNION ALL SELECT 'lacking', {_FOUND('zeppelin')}",
    "rank_metrics": f"WITH r AS ({' UNION ALL '.join(map(_ranked, ('release notes', 'train schedule', 'coffee')))}) SELECT query, round(avg(CASE WHEN rank <= 5 THEN starred::INT END), 6) AS precision_at_k, round(sum(starred::INT / rank) / sum(1.0 / rank), 6) AS hit_quality, sum(greatest(1, length(text) // 4)) AS tokens FROM r GROUP BY query",
    "token_reduction": f"WITH t AS (SELECT sum(greatest(1, length(coalesce(text, '')) // 4)) AS full_tokens, sum(greatest(1, length({CLIP('text', 180)}) // 4)) AS short_tokens FROM documents) SELECT *, round(greatest(0, least(100, 100.0 * (1 - short_tokens / greatest(1, full_tokens)))), 4) AS reduction FROM t",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "lifecycle_fold": _FIRST + f""", o AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY created_at, event_id) AS n FROM ev WHERE memory_id IS NOT NULL),
g AS (SELECT memory_id, list(CASE WHEN event_type = 'reinforce' THEN greatest(-1.0, least(1.0, coalesce(amount, 0.1))) ELSE 0.0 END ORDER BY n) AS s, count(*) AS events, min(created_at) AS first_at, max(created_at) AS last_at, arg_max({_STATES}, n) FILTER (WHERE {_STATES} IS NOT NULL) AS state FROM o GROUP BY 1)
SELECT memory_id, state, round(list_reduce(list_prepend(0.0::DOUBLE, s), lambda x, y: greatest(0.0, least(10.0, x + y))), 6) AS reinforcement, events, strftime(first_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(last_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM g""",
    "heatmap": _VALID + " SELECT (created_at AT TIME ZONE 'UTC')::DATE AS day, state, count(*) AS memories, round(coalesce(avg(reinforcement), 0)::DECIMAL(18,10), 6)::DOUBLE AS mean_reinforcement, round(coalesce(avg(decay_score), 0)::DECIMAL(18,10), 6)::DOUBLE AS mean_decay FROM n GROUP BY ALL",
    "aging": _VALID + f" SELECT memory_id, state, round(coalesce(decay_score, 0), 6) AS decay_score, round(coalesce(reinforcement, 0), 6) AS reinforcement, round(coalesce(importance_score, 0), 6) AS importance_score, {STAMP('last_accessed_at')} AS last_accessed_at, {STAMP('forgotten_at')} AS forgotten_at, {STAMP('updated_at')} AS updated_at, {_action('state')} AS next_action FROM n ORDER BY n.updated_at DESC NULLS LAST, memory_id LIMIT 200",
    "graph_nodes": _VALID + " SELECT memory_id, state, coalesce(reinforcement, 0) AS reinforcement, coalesce(decay_score, 0) AS decay_score, coalesce(importance_score, 0) AS importance_score FROM n ORDER BY updated_at DESC NULLS LAST, memory_id LIMIT 300",
    "graph_edges": "SELECT edge_id, from_memory_id, to_memory_id, relation, coalesce(confidence, 0) AS confidence FROM (SELECT DISTINCT edge_id, from_memory_id, to_memory_id, relation, confidence, created_at FROM memory_edges) ORDER BY created_at DESC NULLS LAST, edge_id LIMIT 300",
    "event_timeline": _FIRST + f" SELECT event_id, memory_id, event_type, {STAMP('created_at')} AS created_at FROM ev WHERE memory_id IN (SELECT memory_id FROM memory_nodes WHERE coalesce(namespace, 'default') = 'default') ORDER BY ev.created_at DESC, event_id LIMIT 200",
    "memory_nodes": ENRICHED + f"SELECT 'mem:' || id AS memory_id, CASE WHEN {TAG('task')} OR {LOW} LIKE '%todo%' THEN 'task' WHEN {TAG('preference')} THEN 'preference' WHEN {TAG('fact')} THEN 'fact' WHEN {TAG('intent')} THEN 'intent' ELSE 'episode' END AS memory_type, {CLIP('text_content', 180)} AS summary_short, {CLIP('text_content', 420)} AS summary_medium, CASE WHEN aging_state = 'archived' THEN 'archived' ELSE 'decaying' END AS state, {_action('aging_state')} AS next_action FROM q",
    "forget": "SELECT CASE WHEN forgotten_at IS NULL AND decay_score >= 0.97 THEN 'forgotten' ELSE state END AS state, count(*) AS nodes FROM memory_nodes GROUP BY 1",
    "conflicts": "WITH n AS (SELECT memory_id, summary_short AS v, confidence AS c FROM memory_nodes QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY updated_at DESC, summary_short DESC NULLS LAST, confidence DESC) = 1), e AS (SELECT DISTINCT * FROM memory_edges WHERE relation = 'contradicts') SELECT edge_id, CASE WHEN abs(a.c - b.c) >= 0.25 THEN CASE WHEN a.c >= b.c THEN a.v ELSE b.v END END AS resolved_value, CASE WHEN abs(a.c - b.c) >= 0.25 THEN 'resolved' ELSE 'open' END AS status FROM e JOIN n a ON a.memory_id = from_memory_id JOIN n b ON b.memory_id = to_memory_id",
    "graph_degree": "WITH e AS (SELECT DISTINCT edge_id, from_memory_id AS f, to_memory_id AS t FROM memory_edges), u AS (SELECT f AS memory_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e) SELECT memory_id, sum(o) AS out_edges, sum(i) AS in_edges FROM u GROUP BY 1 ORDER BY sum(o + i) DESC, memory_id LIMIT 20",
    "backoff": "SELECT event_id, round(least(20.0, 0.8 * pow(2, event_id % 7)), 6) AS seconds, event_id % 7 + 1 >= 4 AS dead FROM events",
    "debounce": "WITH e AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT user_id, count_if(g IS NULL OR g >= 7200000000) AS admitted FROM e GROUP BY 1",
    "tumbling_counts": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*) AS rows FROM events GROUP BY 1, 2",
    "dwell_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e), c AS (SELECT user_id, n, count(*) AS k FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(k) AS longest FROM c GROUP BY 1",
    "export_lines": "SELECT '2' AS schema_version, id FROM items",
} | {f"feed_{m}": _feed(m) for m in ("default", "focus", "light", "explore")}
