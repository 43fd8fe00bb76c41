"""Lexical and vector search, rank fusion, reranking, hybrid search and context building."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from recolta.config import EngineConfig
from recolta.functions import classify as C, scores as S, text as T, urls as U
from recolta.operators import items as I

#: Constants of BM25 and of reciprocal-rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def postings(df: DataFrame, key: str, fields: list[str], positions: bool = False) -> DataFrame:
    """(key, term, tf, doclen) or with positions (key, term, pos, doclen): the inverted index of a table.

    Write it partitioned or bucketed by term to reuse it; a query reads only its own terms.
    """
    terms = F.flatten(F.array(*[T.terms(F.col(c)) for c in fields]))
    docs = df.select(key, terms.alias("_t")).withColumn("doclen", F.size("_t"))
    if positions:
        return docs.select(key, "doclen", F.posexplode("_t").alias("pos", "term"))
    return docs.select(key, "doclen", F.explode("_t").alias("term")).groupBy(key, "doclen", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, key: str, fields: list[str], query: str, keep: list[str] | None = None, fold: bool = False) -> DataFrame:
    """(key, bm25, and the columns in `keep`) of the rows that hold all terms of the query. Statistics count all rows.
    Fields are strings or lists of strings; with fold, diacritics make no difference.

    One pass over the rows counts lengths and the query's terms in place by array functions, so the
    text is never exploded; only matching rows leave the scan. No terms, no rows.
    """
    said = query.lower().translate(str.maketrans(T.MARKED, T.UNMARKED.ljust(len(T.MARKED), "\0"))).replace("\0", "") if fold else query
    wanted = list(dict.fromkeys(T.query_terms(said)))
    text = lambda c: T.folded(F.concat_ws(" ", c)) if fold else F.concat_ws(" ", c)
    terms = F.flatten(F.array(*[T.terms(text(c)) for c in fields]))
    keep = keep or []
    docs = df.select(key, *keep, terms.alias("_t"))
    if not wanted:
        return df.limit(0).select(key, F.lit(0.0).alias("bm25"), *keep)
    count = lambda w: F.size(F.filter("_t", lambda x: x == F.lit(w)))
    tf = [count(w).alias(f"_f{i}") for i, w in enumerate(wanted)]
    counted = docs.select(key, *keep, F.size("_t").alias("_len"), *tf)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(wanted))]).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = math.log((stats.n - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5))
        f = F.col(f"_f{i}").cast("double")
        score = score + F.lit(idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.lit(float(stats.avg or 1.0))))
    every = F.lit(True)
    for i in range(len(wanted)):
        every = every & (F.col(f"_f{i}") > 0)
    return counted.filter(every).select(key, score.alias("bm25"), *keep)


def phrase(df: DataFrame, key: str, fields: list[str], query: str) -> DataFrame:
    """(key, hits) of the rows in which a field holds the query's terms one after another."""
    said = " " + " ".join(T.query_terms(query)) + " "
    hits = F.lit(0)
    for c in fields:
        text = F.concat(F.lit(" "), F.array_join(T.terms(F.col(c)), "  "), F.lit(" "))
        hits = hits + F.regexp_count(text, F.lit(said.replace(" ", "  ")[1:-1]))
    return df.select(key, hits.alias("hits")).filter("hits > 0")


def dot(a: Column, b: Column) -> Column:
    """Sum over the common prefix of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def nearest(df: DataFrame, key: str, vector: str, query: list[float], limit: int = 20) -> DataFrame:
    """(key, distance): the rows of smallest squared distance to one query vector, which is a literal of the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, l2(F.col(vector), q).alias("distance")).orderBy("distance", key).limit(limit)


def nearest_all(df: DataFrame, key: str, vector: str, queries: DataFrame, limit: int = 20, block: int = 4096) -> DataFrame:
    """(query, key, distance): nearest() for each row of queries (key, vector) at once.

    Rows and queries are packed into blocks; each pair of blocks gives the nearest of its own for each query, of which
    the nearest of all are kept. Null vectors and those of another length than the query have no distance.
    """
    kind = dict(df.dtypes)[key]

    def packed(x: DataFrame, size: int, name: str) -> DataFrame:
        parts = F.lit(max(1, -(-x.count() // size)))
        own = x.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
        return own.groupBy(F.pmod(F.xxhash64(key), parts).alias("b"), F.size("v").alias("dim")).agg(F.collect_list(F.struct(F.col(key).alias("k"), "v")).alias(name)).drop("b")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows, asked in zip(b["rows"], b["asked"]):
                keys = np.array([r["k"] for r in rows])
                vectors = np.array([r["v"] for r in rows], float)
                for q in asked:
                    far = ((vectors - np.array(q["v"], float)) ** 2).sum(1)
                    at = np.lexsort((keys, far))[:limit]
                    yield pd.DataFrame({"query": q["k"], key: keys[at], "distance": far[at]})

    pairs = packed(df, block, "rows").join(packed(queries, 256, "asked"), "dim").select("rows", "asked")
    found = pairs.mapInPandas(partial, f"query {kind}, {key} {kind}, distance double")
    return found.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy("distance", key))).filter(F.col("_n") <= limit).drop("_n")


def _signed_hashes(text: Column, n: int) -> Column:
    """array<struct<i, w>>: the dimension and signed weight of each token."""
    hexed = lambda h, a, k: F.conv(F.substring(h, a, k), 16, 10).cast("long")
    part = lambda h: F.struct((hexed(h, 1, 4) % n).cast("int").alias("i"), (F.when(hexed(h, 5, 2) % 2 == 0, 1.0).otherwise(-1.0) * (1.0 + hexed(h, 7, 2) / 255.0 * 0.2)).alias("w"))
    return F.transform(F.transform(T.tokens(text), lambda t: F.sha2(t, 256)), part)


def hash_embedding(df: DataFrame, key: str, text: str, dimensions: int = 128) -> DataFrame:
    """(key, vector): signed token hashes, summed per dimension and normalised, by built-in functions within a row."""
    n = max(16, dimensions)
    weight = lambda p, i: F.aggregate(F.filter(p, lambda x: x["i"] == i), F.lit(0.0), lambda s, x: s + x["w"])
    sums = lambda p: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: weight(p, i))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda v: U.let(norm(v), lambda m: F.when(m > 0, F.transform(v, lambda x: x / m)).otherwise(v))
    return df.select(key, U.let(_signed_hashes(F.col(text), n), lambda p: U.let(sums(p), unit)).alias("vector"))


def nearest_text(df: DataFrame, key: str, text: str, query: list[float], limit: int = 20) -> DataFrame:
    """nearest() over hash_embedding() without making the vectors: of each row's sorted token hashes one pass sums
    the norm and the product with the query vector, in time linear in the text."""
    q = F.array(*[F.lit(float(x)) for x in query])
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("dot"))

    def step(s: Column, x: Column) -> Column:
        same = s["i"] == x["i"]
        return F.struct(x["i"].alias("i"), F.when(same, s["run"] + x["w"]).otherwise(x["w"]).alias("run"), F.when(same, s["sq"]).otherwise(s["sq"] + s["run"] * s["run"]).alias("sq"), (s["dot"] + x["w"] * F.element_at(q, x["i"] + 1)).alias("dot"))

    norm = lambda s: F.sqrt(s["sq"] + s["run"] * s["run"])
    size = float(sum(x * x for x in query))
    distance = lambda s: F.when(norm(s) > 0, 1.0 + size - 2.0 * s["dot"] / norm(s)).otherwise(F.lit(size))
    made = F.aggregate(F.array_sort(_signed_hashes(F.col(text), len(query))), start, step, distance)
    return df.select(key, made.alias("distance")).orderBy("distance", key).limit(limit)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Ranks from 1 of a list that is already cut to a few rows."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def fuse(lexical: DataFrame, semantic: DataFrame, key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """(key, rrf, rank) of two ranked lists (key, rank) of few rows: sums of reciprocal ranks; ties in lexical order first."""
    if limit <= 0:
        return lexical.limit(0).select(key, F.lit(0.0).alias("rrf"), F.lit(0).alias("rank"))
    a, b = lexical.select(key, F.col("rank").alias("_a")), semantic.select(key, F.col("rank").alias("_b"))
    both = a.join(b, key, "full_outer")
    score = F.coalesce(1.0 / (k + F.col("_a")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("_b")), F.lit(0.0))
    order = [F.desc("rrf"), F.col("_a").asc_nulls_last(), F.col("_b").asc_nulls_last(), F.col(key)]
    return numbered(both.withColumn("rrf", score).orderBy(*order).limit(limit), order).select(key, "rrf", "rank")


def diversity(df: DataFrame, cluster: str, platform: str, order: list[Column], factor: float = 0.3) -> DataFrame:
    """score minus a penalty for each earlier row of the same cluster or platform (diversity_penalty), for few rows."""
    dup = F.row_number().over(W.partitionBy(cluster).orderBy(*order)) - 1
    same = F.row_number().over(W.partitionBy(platform).orderBy(*order)) - 1
    raw = dup * factor + same * (factor * 0.35)
    return df.withColumn("_raw", raw).withColumn("score", F.round(F.col("score") - F.col("_raw"), 8)).withColumn("diversity_penalty", F.round("_raw", 6)).drop("_raw")


def indexed(items: DataFrame) -> list[str]:
    """The columns of the full-text index."""
    return [c for c in ("text_content", "image_captions", "author") if c in items.columns]


def hybrid(items: DataFrame, query: str, cfg: EngineConfig, limit: int = 10, days_back: int | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Search over items: BM25 and vectors, fused, scored with a trace and reranked.

    vectors (id, vector) default to hash embeddings. The legs read only their own columns; only ids and
    ranks pass through the fusion, at most max(4 limit, 40) of them, and only those rows are enriched.
    A blank query gives no rows.
    """
    spark = items.sparkSession
    if not query.strip():
        ranked: list = []
    else:
        judged = ["namespace", "archived_at", "captured_at", *(["search_hidden"] if "search_hidden" in items.columns else ["text_content", "url"])]
        open_to = lambda df: I.since(I.visible(I.in_namespace(df, cfg), cfg), days_back, cfg)

        def shown(df: DataFrame) -> DataFrame:  # rows that hold secrets are found by patterns, so only candidates are judged
            hidden = F.coalesce("search_hidden", F.lit(False)) if "search_hidden" in df.columns else C.sensitivity(F.col("text_content"), F.col("url"))[0] == "high"
            return df.filter(~hidden) if cfg.hide_sensitive else df

        hits = shown(open_to(bm25(items, "id", indexed(items), query, judged, fold=True)))
        lexical = numbered(hits.select("id", "bm25").orderBy(F.desc("bm25"), "id").limit(20), [F.desc("bm25"), F.col("id")])
        own = open_to(items)
        q = hash_embedding(spark.createDataFrame([("q", query)], "id string, t string"), "id", "t").first().vector
        reach = lambda df, n: nearest_text(df, "id", "text_content", q, n) if vectors is None else nearest(vectors.join(df.select("id"), "id", "left_semi"), "id", "vector", q, n)
        first = reach(own, 100).collect()
        near = spark.createDataFrame(first, "id string, distance double")
        close = shown(items.select("id", *judged).join(F.broadcast(near), "id")).select("id", "distance").orderBy("distance", "id").limit(20).collect()
        if len(close) < 20 and len(first) == 100:  # so many of the nearest are hidden: judge all rows first
            close = reach(shown(own), 20).collect()
        semantic = numbered(spark.createDataFrame(close, "id string, distance double"), [F.col("distance"), F.col("id")])
        ranked = fuse(lexical, semantic, "id", max(4 * limit, 40)).collect()
    fused = spark.createDataFrame(ranked, "id string, rrf double, rank int")
    rows = I.enrich(items.join(F.broadcast(fused), "id"), cfg)
    rows = rows.withColumn("cluster", U.cluster_key(F.col("canonical_url"), F.col("url"), F.col("text_content"))).withColumn("base", T.clamp(1.0 / (1.0 + F.col("rrf"))))
    few = rows.orderBy("rank").limit(3 * limit)
    few = few.withColumn("dup", F.when(F.row_number().over(W.partitionBy("cluster").orderBy("rank")) > 1, 0.12).otherwise(0.0))
    hay = F.concat(F.lower(T.text_or_empty("text_content")), F.lit(" "), F.array_join("related_topics", " "))
    terms = S.retrieval_score(query, F.col("base"), F.col("captured_at"), F.col("importance_score"), hay, F.col("capture_confidence"), F.col("dup"), F.col("decay_score"), F.col("archived_at"), cfg.as_of)
    trace = F.struct(*[F.round(terms[t], 6).alias(t) for t in ("semantic", "temporal", "importance", "context", "reliability", "duplicate", "stale")])
    scored = few.withColumn("score", F.round(terms["total"], 8)).withColumn("trace", trace).withColumn("matched", I.matched_fields(query.strip(), F.col("text_content"), F.coalesce("author_name", "author"), F.coalesce("canonical_url", "url"), F.col("related_topics")))
    scored = scored.withColumn("_all", F.count(F.lit(1)).over(W.partitionBy()))
    if cfg.diversity and cfg.diversity_factor > 0:
        turned = diversity(scored.withColumn("_kept", F.col("score")), "cluster", "platform", [F.col("rank")], cfg.diversity_factor)
        enough = F.col("_all") >= 3  # with fewer rows neither score nor order changes
        scored = turned.withColumn("score", F.when(enough, F.col("score")).otherwise(F.col("_kept"))).withColumn("diversity_penalty", F.when(enough, F.col("diversity_penalty")).otherwise(0.0)).withColumn("_by", F.when(enough, -F.col("score")).otherwise(0.0))
    else:
        scored = scored.withColumn("diversity_penalty", F.lit(0.0)).withColumn("_by", F.lit(0.0))
    order = [F.col("_by"), F.col("rank")]
    out = numbered(scored.orderBy(*order).limit(limit), order, "position")
    return out.select("position", "id", "platform", "url", "captured_at", I.excerpt(F.col("text_content")).alias("text_excerpt"), "score", "diversity_penalty", "cluster", "trace", "matched")


def rag_context(hits: DataFrame, order: str, cfg: EngineConfig) -> DataFrame:
    """(rank, source_index, id, line): numbered context lines while they fit the budget, for few hits."""
    budget = max(500, min(cfg.context_chars, 16000))
    snippet, url = T.clip(F.col("text_excerpt"), 320, False), T.clip(F.col("url"), 280, False)
    rows = numbered(hits, [F.col(order)], "source_index").withColumn("snippet", snippet).filter("snippet <> ''")
    rows = numbered(rows, [F.col("source_index")], "rank")
    stamp = F.coalesce(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] ("), F.coalesce("platform", F.lit("unknown")), F.lit(", "), stamp, F.lit(") "), "snippet", F.when(url != "", F.concat(F.lit(" | source="), url)).otherwise(""))
    used = F.sum(F.length("line") + 1).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) - 1
    return rows.withColumn("line", line).withColumn("_used", used).filter(F.col("_used") <= budget).select("rank", "source_index", "id", "line")


def feed(enriched: DataFrame, cfg: EngineConfig, mode: str = "default", limit: int = 20) -> DataFrame:
    """The ranked feed: the hottest candidates of the namespace, scored, the best first. Both cuts are top-k. A row
    that was surfaced counts as untouched since `last_surfaced`, where the table has that column."""
    live = I.in_namespace(enriched, cfg).filter(F.col("archived_at").isNull())
    few = live.orderBy(F.desc("heat"), F.desc("captured_at"), "id").limit(max(12 * limit, 120))
    age = S.age_days(F.col("captured_at"), cfg.as_of)
    bonus = S.mode_bonus(mode, F.col("content_type"), F.col("text_content"), F.col("surfaced_count"))
    untouched = S.age_days(F.coalesce("last_surfaced", "captured_at"), cfg.as_of) if "last_surfaced" in few.columns else age
    score, reason, review = S.feed_score(age, untouched, F.col("heat"), F.col("dwell_seconds"), F.col("starred"), F.col("decay_score"), F.col("noise_score"), bonus)
    scored = few.select("id", "platform", "heat", I.excerpt(F.col("text_content"), 220).alias("text_excerpt"), F.round(score, 6).alias("score"), reason.alias("surface_reason"), review.alias("needs_review"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def resurface(items: DataFrame, query: str, cfg: EngineConfig, limit: int = 5, source_id: str | None = None) -> DataFrame:
    """Related memories of a context: search hits without the source, with a heat bonus and what heat they gain."""
    found = hybrid(items, first_words(query), cfg, min(max(3 * limit, limit + 5), 30))
    heat = items.select("id", "heat")
    rows = found.join(heat, "id").withColumn("surface_score", F.round(F.col("score") + 0.1 * F.coalesce("heat", F.lit(1.0)), 6)).withColumn("heat_delta", F.greatest(F.lit(0.12), 0.42 - 0.04 * (F.col("position") - 1)))
    rows = rows.filter(F.col("id") != source_id) if source_id else rows
    return rows.orderBy(F.desc("surface_score"), "id").limit(limit).select("id", "surface_score", "heat_delta")


def first_words(query: str, n: int = 140) -> str:
    """The first words of a context."""
    return " ".join(query.split()[:n])
