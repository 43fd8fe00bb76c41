"""Queries of the retrieval and analytics operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recolta.config import EngineConfig
from recolta.functions import classify as C, scores as S, text as T, urls as U
from recolta.operators import analytics as A, extract as X, items as I, lifecycle as L, near_dup as N, search as R
from recolta.plans.core_sql import SQL  # noqa: F401
from recolta.sources.tables import table
from recolta.streaming import sequential as Q

CFG = EngineConfig().checked()
QUERY = "release notes"
CASES = [("checklist", "recall", ["checklist", "itinerary"]), ("bakery", "recall", ["zeppelin"]), ("memory", "consistency", ["long thread about memory"]), ("stale", "staleness", ["old laptop"]), ("contra", "contradiction", ["unpopular opinion"])]
FAILURES = [("found", ["release notes", "train schedule"], ["zeppelin"]), ("banned", ["release notes"], ["coffee"]), ("lacking", ["zeppelin"], [])]
HTML = {"text_selectors": ["article .body p", "[data-text]"], "author_selectors": ["a.author"], "author_handle_selectors": ["span#handle"], "canonical_url_selectors": ["link[rel=canonical]", "a.permalink"], "media_selectors": ["img[src^='https://']"], "fallback_selectors": {"text": ["p"], "media": ["img"]}}


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return I.enrich(items(spark, d), CFG)


def stamp(c: str) -> F.Column:
    """An instant as text in UTC."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _flat(df: DataFrame) -> DataFrame:
    return df.select("*", "trace.*").drop("trace")


def list_items(s: SparkSession, d: str) -> DataFrame:
    return I.newest(I.in_namespace(items(s, d), CFG), 50, 10, "twitter").select("id", "platform", stamp("captured_at"))


def point_lookup(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).filter(F.col("id") == items(s, d).agg(F.max("id")).first()[0]).select("id", "url", "author")


def multi_get(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "memory_nodes").filter("state = 'forgotten'").select(F.col("item_id").alias("id"))
    return I.by_ids(items(s, d), ids).select("id", "platform", "author")


def timeline_day(s: SparkSession, d: str) -> DataFrame:
    return I.newest(I.on_day(items(s, d), "2026-03-10")).select("id", stamp("captured_at"), "platform")


def hour_groups(s: SparkSession, d: str) -> DataFrame:
    return A.hour_groups(I.on_day(items(s, d), "2026-03-10"))


def bm25_search(s: SparkSession, d: str) -> DataFrame:
    i = items(s, d)
    own = I.visible(I.in_namespace(i, CFG), CFG).select("id")
    hits = R.bm25(i, "id", R.indexed(i), QUERY, fold=True).join(own, "id", "left_semi")
    return hits.select("id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(50)


def phrase_search(s: SparkSession, d: str) -> DataFrame:
    return R.phrase(items(s, d), "id", ["text_content"], QUERY)


def postings_stats(s: SparkSession, d: str) -> DataFrame:
    return R.postings(items(s, d), "id", ["text_content"]).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("hits"))


def vector_knn(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = e.filter("vec_id = 0").first().embedding
    return R.nearest(e, "vec_id", "embedding", q, 20).select("vec_id", F.round("distance", 6).alias("distance"))


def vector_knn_all(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return R.nearest_all(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), 20).withColumn("distance", F.round("distance", 6))


def cosine_by_label(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = e.filter("vec_id = 0").first().embedding
    return e.groupBy("label").agg(F.round(F.avg(R.dot(F.col("embedding"), F.array(*map(F.lit, q)))), 6).alias("mean_cosine"), F.count(F.lit(1)).alias("vectors"))


def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    v = R.hash_embedding(items(s, d), "id", "text_content", 32)
    return v.select("id", *[F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in range(32)])


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    a = R.numbered(items(s, d).orderBy(F.desc("heat"), "id").limit(40), [F.desc("heat"), F.col("id")]).select("id", "rank")
    b = R.numbered(items(s, d).orderBy(F.desc("dwell_seconds"), "id").limit(40), [F.desc("dwell_seconds"), F.col("id")]).select("id", "rank")
    return R.fuse(a, b, "id", 30).select("id", F.round("rrf", 8).alias("rrf"), "rank")


def diversity_rerank(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "feed_items").select("id", U.platform_name(F.col("platform")).alias("platform"), F.coalesce("cluster_id", F.lit("")).alias("cluster"), "score").distinct().orderBy(F.desc("score"), "id", "cluster", "platform").limit(200)
    return R.diversity(f, "cluster", "platform", [F.desc("score"), F.col("id")]).select("id", "score", "diversity_penalty")


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return R.hybrid(items(s, d), QUERY, CFG, 10).select("position", "id", "score", "diversity_penalty", "text_excerpt")


def retrieval_trace(s: SparkSession, d: str) -> DataFrame:
    return _flat(R.hybrid(items(s, d), QUERY, CFG, 10).select("position", "id", "trace", F.array_join("matched", ",").alias("matched")))


def rag_context(s: SparkSession, d: str) -> DataFrame:
    return R.rag_context(R.hybrid(items(s, d), QUERY, CFG, 8), "position", CFG)


def context_lines(s: SparkSession, d: str) -> DataFrame:
    top = items(s, d).orderBy(F.desc("heat"), "id").limit(30).select("id", U.platform_name(F.col("platform")).alias("platform"), "captured_at", F.col("text_content").alias("text_excerpt"), "url", (-F.col("heat")).alias("o"))
    return R.rag_context(R.numbered(top, [F.col("o"), F.col("id")], "position"), "position", CFG).select("rank", "source_index", "id")


def _feed(mode: str):
    return lambda s, d: R.feed(enriched(s, d), CFG, mode)


def resurface(s: SparkSession, d: str) -> DataFrame:
    return R.resurface(items(s, d), QUERY, CFG)


def library_feed(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "feed_items").join(items(s, d).select("id", "dwell_seconds", "quality_flags", "capture_confidence"), "id")
    age = S.age_days(F.col("captured_at"), CFG.as_of)
    score, reason, review = S.library_feed_score(age, age, F.col("heat"), F.col("importance_score"), F.lit(0.0), F.col("recency_score"), F.col("dwell_seconds"), F.col("starred"), F.col("quality_flags"), F.coalesce("capture_confidence", F.lit(1.0)), S.mode_bonus("light", F.col("content_type"), F.col("text_excerpt"), F.col("surfaced_count")))
    return f.select("id", F.round("score", 6).alias("stored"), F.round(score, 6).alias("library_score"), reason.alias("reason"), review.alias("review"))


def decay_states(s: SparkSession, d: str) -> DataFrame:
    return enriched(s, d).select("id", "memory_type", "decay_score", "aging_state", S.next_action(F.col("decay_score"), F.col("aging_state")).alias("next_action"))


def ranking_primitives(s: SparkSession, d: str) -> DataFrame:
    return enriched(s, d).select("id", "importance_score", "resurfacing_score", "recency_score", "recurrence_score")


def auto_archive(s: SparkSession, d: str) -> DataFrame:
    return I.auto_archive(enriched(s, d), EngineConfig(low_score=0.6)).filter("archive_reason is not null").select("id", "archive_reason")


def heat_decay(s: SparkSession, d: str) -> DataFrame:
    return I.heat_decay(items(s, d), CFG).select("id", F.round("heat", 6).alias("heat"))


def additive_rank(s: SparkSession, d: str) -> DataFrame:
    e = enriched(s, d)
    return e.select("id", S.additive_rank(F.lit(0.9), F.col("captured_at"), F.col("heat"), F.lit(0.12), F.col("noise_score"), F.col("capture_confidence"), CFG.as_of).alias("rank_score"))


def noise(s: SparkSession, d: str) -> DataFrame:
    score, reason = C.noise(F.col("text_content"), F.col("image_urls"))
    return items(s, d).select("id", F.round(score, 6).alias("noise_score"), reason.alias("noise_reason"))


def prompt_risk(s: SparkSession, d: str) -> DataFrame:
    score, reason = C.prompt_risk(F.col("text_content"))
    suspicious, signals = C.prompt_injection(F.col("text_content"))
    return items(s, d).select("id", score.alias("risk"), reason.alias("reason"), suspicious.alias("suspicious"), F.array_join(signals, ",").alias("signals"))


def sensitivity(s: SparkSession, d: str) -> DataFrame:
    level, reasons = C.sensitivity(F.col("text_content"), F.col("url"))
    return items(s, d).select("id", level.alias("level"), F.array_join(reasons, ",").alias("reasons"), F.array_join(C.sensitive_scan(F.col("text_content")), ",").alias("scan"))


def redact(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("id", C.redact(F.col("text_content")).alias("redacted"))


def sanitize(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", C.sanitize(F.col("text")).alias("clean"))


def topics(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("id", F.array_join(T.topics(F.col("text_content")), ",").alias("topics"))


def entities(s: SparkSession, d: str) -> DataFrame:
    t, e = T.topics(F.col("text_content")), T.entities(F.col("text_content"))
    return items(s, d).select("id", F.array_join(e, ",").alias("entities"), T.semantic_group(t, e).alias("semantic_group"))


def clip_summaries(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", T.clip(t, 180).alias("short"), T.clip(t, 420).alias("medium"), T.first_words(t, 140).alias("words"))


def embedding_text(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("id", T.embedding_text(F.col("text_content"), F.col("image_captions"), F.col("tags"), F.col("author"), 40).alias("text"))


def canonical_urls(s: SparkSession, d: str) -> DataFrame:
    u, p = F.col("url"), F.col("platform")
    return items(s, d).select("id", U.canonical_url(u, p).alias("canonical"), U.post_id(u, p).alias("post_id"), U.domain(u).alias("domain"), U.detect_platform(u, p).alias("detected"), U.content_type(u, F.col("image_urls")).alias("kind"))


def cluster_keys(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("id", U.cluster_key(F.col("canonical_url"), F.col("url"), F.col("text_content")).alias("cluster"))


def fingerprints(s: SparkSession, d: str) -> DataFrame:
    b = C.time_bucket(F.col("captured_at"))
    return items(s, d).select("id", b.alias("bucket"), C.fingerprint(F.col("canonical_url"), F.col("platform"), F.col("text_content"), F.col("author_name"), b).alias("fingerprint"))


def capture_confidence(s: SparkSession, d: str) -> DataFrame:
    u, p = F.col("url"), F.col("platform")
    fallback = F.when(F.get_json_object("capture_debug", "$.selector") == "fallback", F.array(F.lit("selector"))).otherwise(F.array().cast("array<string>"))
    score, reasons = S.capture_confidence(F.col("text_content"), F.coalesce("canonical_url", "url"), F.coalesce("author_name", "author"), F.col("image_urls"), U.post_id(u, p), F.col("quality_flags"), fallback, U.valid_url(F.coalesce("canonical_url", "url")))
    return items(s, d).select("id", score.alias("confidence"), F.array_join(reasons, ",").alias("reasons"))


def keep_first(s: SparkSession, d: str) -> DataFrame:
    return I.first_ids(items(s, d), "dedupe_key")


def insert_ignore(s: SparkSession, d: str) -> DataFrame:
    old, new = items(s, d).filter("captured_at < '2026-04-01'"), items(s, d).filter("captured_at >= '2026-04-01'")
    return I.insert_ignore(old, new)[1].groupBy("inserted").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("existing_id").alias("existing"))


def patch_items(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "memory_nodes").groupBy(F.col("item_id").alias("id")).agg(F.min("importance_score").alias("heat"), F.max("namespace").alias("namespace"))
    return I.patch(items(s, d).select("id", "heat", "namespace", "author"), p)


def bump_heat(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "feed_items").select("id", (F.col("recency_score") + 0.1).alias("amount"))
    return I.bump_heat(items(s, d).select("id", "heat"), b).select("id", F.round("heat", 6).alias("heat"))


def mark_surfaced(s: SparkSession, d: str) -> DataFrame:
    return I.mark_surfaced(items(s, d).select("id", "heat", "surfaced_count"), table(s, d, "feed_items").filter("starred").select("id")).select("id", F.round("heat", 6).alias("heat"), "surfaced_count")


def stats_overview(s: SparkSession, d: str) -> DataFrame:
    return A.overview(I.in_namespace(items(s, d), CFG), "2026-03-10 12:00:00")


def by_platform(s: SparkSession, d: str) -> DataFrame:
    return A.counts_by(items(s, d), U.platform_name(F.col("platform")), "platform")


def by_type(s: SparkSession, d: str) -> DataFrame:
    return A.counts_by(items(s, d), F.col("content_type"), "content_type")


def reliability(s: SparkSession, d: str) -> DataFrame:
    i = items(s, d)
    flags = F.exists("quality_flags", lambda f: f.startswith("missing_"))
    m = i.select(U.platform_name(F.col("platform")).alias("platform"), F.lit(1).alias("attempts"), F.when(F.col("capture_confidence") > 0.5, 1).otherwise(0).alias("stored"), F.when(F.col("surfaced_count") > 3, 1).otherwise(0).alias("duplicates"), F.when(flags, 1).otherwise(0).alias("missing"))
    return A.capture_reliability(m)


def dashboard(s: SparkSession, d: str) -> DataFrame:
    return A.reliability_dashboard(items(s, d))


def recall_eval(s: SparkSession, d: str) -> DataFrame:
    return A.case_hits(items(s, d), "text_content", CASES)


def evaluation(s: SparkSession, d: str) -> DataFrame:
    return A.evaluation(A.case_hits(items(s, d), "text_content", CASES))


def failure_cases(s: SparkSession, d: str) -> DataFrame:
    return A.failure_cases(items(s, d), "text_content", FAILURES)


def rank_metrics(s: SparkSession, d: str) -> DataFrame:
    parts = []
    for q in ("release notes", "train schedule", "coffee"):
        hits = R.bm25(items(s, d), "id", ["text_content"], q).orderBy(F.round("bm25", 6).desc(), "id").limit(10)
        ranked = R.numbered(hits, [F.round("bm25", 6).desc(), F.col("id")]).join(items(s, d).select("id", "text_content", "starred"), "id")
        parts.append(ranked.select(F.lit(q).alias("query"), "rank", F.col("starred").alias("relevant"), F.col("text_content").alias("text")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return A.rank_metrics(out)


def token_reduction(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("text", T.clip(F.col("text"), 180).alias("short"))
    return A.token_reduction(docs, "text", "short")


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return A.percentiles(table(s, d, "events"), "value", "event_type")


def verify_findings(s: SparkSession, d: str) -> DataFrame:
    return A.findings(items(s, d))


def repair(s: SparkSession, d: str) -> DataFrame:
    return A.repaired(items(s, d)).filter("canonical_url is not null").select("id", "canonical_url")


def lifecycle_fold(s: SparkSession, d: str) -> DataFrame:
    return L.fold(table(s, d, "memory_events")).select("memory_id", "state", "reinforcement", "events", stamp("first_at"), stamp("last_at"))


def heatmap(s: SparkSession, d: str) -> DataFrame:
    return L.heatmap(table(s, d, "memory_nodes"), "default")


def aging(s: SparkSession, d: str) -> DataFrame:
    return L.aging(table(s, d, "memory_nodes"), "default").withColumns({c: stamp(c) for c in ("last_accessed_at", "forgotten_at", "updated_at")})


def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return L.recent_graph(table(s, d, "memory_nodes"), table(s, d, "memory_edges"), "default")[0]


def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return L.recent_graph(table(s, d, "memory_nodes"), table(s, d, "memory_edges"), "default")[1]


def event_timeline(s: SparkSession, d: str) -> DataFrame:
    return L.latest(table(s, d, "memory_events"), table(s, d, "memory_nodes"), "default", 200).withColumn("created_at", stamp("created_at"))


def memory_nodes(s: SparkSession, d: str) -> DataFrame:
    return L.nodes_of(enriched(s, d), CFG.as_of).select("memory_id", "memory_type", "summary_short", "summary_medium", "state", "next_action")


def forget(s: SparkSession, d: str) -> DataFrame:
    return L.forget(table(s, d, "memory_nodes"), CFG.as_of).groupBy("state").agg(F.count(F.lit(1)).alias("nodes"))


def conflicts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "memory_edges").filter("relation = 'contradicts'").distinct()
    n = table(s, d, "memory_nodes").groupBy("memory_id").agg(F.max_by(F.struct("summary_short", "confidence"), F.struct("updated_at", "summary_short", "confidence")).alias("v"))
    side = lambda c, x: n.select(F.col("memory_id").alias(c), F.col("v.summary_short").alias(f"value_{x}"), F.col("v.confidence").alias(f"confidence_{x}"))
    pairs = e.join(side("from_memory_id", "a"), "from_memory_id").join(side("to_memory_id", "b"), "to_memory_id")
    return L.resolve_conflicts(pairs).select("edge_id", "resolved_value", "status")


def relations(s: SparkSession, d: str) -> DataFrame:
    return L.relations(enriched(s, d)).groupBy("relation", "confidence").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("from_id").alias("sources"))


def graph_degree(s: SparkSession, d: str) -> DataFrame:
    return L.degrees(table(s, d, "memory_edges"), 20)


def near_dup_similarity(s: SparkSession, d: str) -> DataFrame:
    return N.near_duplicates_within(items(s, d))


def html_extract(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    page = F.concat(F.lit("<html><head><link rel=canonical href='https://"), "source", F.lit("/"), "doc_id", F.lit("'></head><body><article><a class='author big'>"), "source", F.lit("</a><div class=body><p>"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></div><img src='https://img.example/1.png'></article></body></html>"))
    return X.extract(docs.select("doc_id", page.alias("html")), "doc_id", "html", HTML).select("doc_id", "author_name", "canonical_url", F.size("media_urls").alias("media"), F.array_join("quality_flags", ",").alias("flags"))


def rate_limit(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = Q.admit(e, "user_id", "ts", "event_id", lambda: Q.SlidingLog(3, 3600.0))
    return got.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))


def circuit_breaker(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("fine", F.col("event_type") != "error")
    return Q.admit(e, "user_id", "ts", "event_id", lambda: Q.Breaker(2, 86400.0), "fine").groupBy("user_id").agg(F.count_if("admitted").alias("called"))


def backoff(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("attempt", (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", F.round(S.backoff_seconds(F.col("attempt")), 6).alias("seconds"), (F.col("attempt") >= 4).alias("dead"))


def debounce(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return Q.admit(e, "user_id", "ts", "event_id", lambda: Q.Debounce(7200.0)).groupBy("user_id").agg(F.count_if("admitted").alias("admitted"))


def tumbling_counts(s: SparkSession, d: str) -> DataFrame:
    from recolta.streaming.pipelines import tumbling

    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e, "ts", ["event_type"], "1 hour").withColumn("window_start", stamp("window_start"))


def dwell_sessions(s: SparkSession, d: str) -> DataFrame:
    from recolta.streaming.pipelines import sessions

    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("rows").alias("longest"))


def export_lines(s: SparkSession, d: str) -> DataFrame:
    return I.to_export(items(s, d).select("id", "url")).select("schema_version", F.get_json_object("item", "$.id").alias("id"))


QUERIES = {f.__name__: f for f in (
    list_items, point_lookup, multi_get, timeline_day, hour_groups, bm25_search, phrase_search, postings_stats, vector_knn, vector_knn_all, cosine_by_label, hash_embedding, rrf_fusion, diversity_rerank, hybrid_search, retrieval_trace,
    rag_context, context_lines, resurface, library_feed, decay_states, ranking_primitives, auto_archive, heat_decay, additive_rank, noise, prompt_risk, sensitivity, redact, sanitize, topics, entities, clip_summaries, embedding_text,
    canonical_urls, cluster_keys, fingerprints, capture_confidence, keep_first, insert_ignore, patch_items, bump_heat, mark_surfaced, stats_overview, by_platform, by_type, reliability, dashboard, recall_eval, evaluation, failure_cases,
    rank_metrics, token_reduction, latency_percentiles, verify_findings, repair, lifecycle_fold, heatmap, aging, graph_nodes, graph_edges, event_timeline, memory_nodes, forget, conflicts, relations, graph_degree, near_dup_similarity, html_extract, rate_limit,
    circuit_breaker, backoff, debounce, tumbling_counts, dwell_sessions, export_lines,
)} | {f"feed_{m}": _feed(m) for m in ("default", "focus", "light", "explore")}
