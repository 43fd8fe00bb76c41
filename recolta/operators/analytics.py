"""Statistics, reliability, retrieval evaluation and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recolta.functions import classify as C, scores as S, text as T, urls as U


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(0.0)


def overview(df: DataFrame, as_of: str) -> DataFrame:
    """One row: total, today, starred, low_confidence, missing_required and health_score, in one pass."""
    today = F.to_date("captured_at") == F.to_date(S.instant(as_of))
    low = F.coalesce("capture_confidence", F.lit(1.0)) < 0.7
    lacking = F.exists(F.coalesce("quality_flags", F.array().cast("array<string>")), lambda f: f.startswith("missing_"))
    got = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(today).alias("today"), F.count_if("starred").alias("starred"), F.count_if(low).alias("low_confidence"), F.count_if(lacking).alias("missing_required"))
    return got.withColumn("health_score", F.round(F.greatest(F.lit(0.0), 1.0 - (F.col("low_confidence") + F.col("missing_required")) / F.greatest(F.lit(1), F.col("total"))), 4))


def counts_by(df: DataFrame, c: Column, name: str) -> DataFrame:
    return df.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("items"))


def capture_reliability(metrics: DataFrame) -> DataFrame:
    """Rates by platform of (platform, attempts, stored, duplicates, missing)."""
    s = metrics.groupBy("platform").agg(*[F.sum(c).alias(c) for c in ("attempts", "stored", "duplicates", "missing")])
    a = F.col("attempts")
    return s.select("platform", "attempts", rate(F.col("stored"), a).alias("success_rate"), rate(F.greatest(F.lit(0), a - F.col("stored") - F.col("duplicates")), a).alias("fail_rate"), rate(F.col("duplicates"), a).alias("duplicate_rate"), rate(F.col("missing"), a).alias("missing_rate"))


def reliability_dashboard(df: DataFrame) -> DataFrame:
    """One row: duplicate rate by fingerprint, mean confidence, fallback use and share with missing fields."""
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    fallback = F.get_json_object("capture_debug", "$.selector") == "fallback"
    share = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)), 6)
    return df.agg(F.round(F.coalesce(F.avg(T.py_or(F.col("capture_confidence"), 1.0)), F.lit(0.0)), 6).alias("mean_confidence"), share(fallback).alias("fallback_rate"), share(F.exists(flags, lambda f: f.startswith("missing_"))).alias("missing_rate"), share(F.array_contains(flags, "duplicate_risk")).alias("duplicate_rate"))


def hour_groups(df: DataFrame) -> DataFrame:
    """(hour, items, first_id, last_id) of a day's rows; groups are summarised, never collected."""
    return df.groupBy(F.hour("captured_at").alias("hour")).agg(F.count(F.lit(1)).alias("items"), F.min_by("id", F.struct("captured_at", "id")).alias("first_id"), F.max_by("id", F.struct("captured_at", "id")).alias("last_id"))


def case_hits(docs: DataFrame, text: str, cases: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(case, kind, hits, hit): for each case (name, kind, words) how many texts hold any of its words. One pass."""
    low = F.lower(T.text_or_empty(F.col(text)))

    def any_of(words: list[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        return hit

    row = docs.agg(*[F.count_if(any_of(w)).alias(f"c{i}") for i, (_, _, w) in enumerate(cases)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("case"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("hits")) for i, (n, k, _) in enumerate(cases)]))
    return row.select(each.alias("x")).select("x.*").withColumn("hit", F.col("hits") > 0)


def evaluation(hits: DataFrame) -> DataFrame:
    """One row of recall, consistency, staleness and contradiction: hit cases of each kind over its cases."""
    kinds = ("recall", "consistency", "staleness", "contradiction")
    of = lambda k: F.round(F.count_if((F.col("kind") == k) & F.col("hit")) / F.greatest(F.lit(1), F.count_if(F.col("kind") == k)), 6).alias(k)
    return hits.agg(*[of(k) for k in kinds])


def rank_metrics(ranked: DataFrame, k: int = 5, top: int = 10) -> DataFrame:
    """(query, precision_at_k, hit_quality, tokens) of (query, rank, relevant, text): precision over the first k,
    reciprocal-rank weighted quality and estimated tokens over the first `top`."""
    in_k, in_top = F.col("rank") <= k, F.col("rank") <= top
    gain = F.col("relevant").cast("double")
    weight = 1.0 / F.col("rank")
    tokens = F.when(F.length("text") > 0, F.greatest(F.lit(1), F.floor(F.length("text") / 4))).otherwise(0)
    got = ranked.groupBy("query").agg(F.avg(F.when(in_k, gain)).alias("p"), F.sum(F.when(in_top, gain * weight)).alias("g"), F.sum(F.when(in_top, weight)).alias("w"), F.sum(F.when(in_top, tokens)).alias("tokens"))
    return got.select("query", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("precision_at_k"), F.round(F.coalesce(F.col("g") / F.col("w"), F.lit(0.0)), 6).alias("hit_quality"), "tokens")


def token_reduction(df: DataFrame, full: str, short: str) -> DataFrame:
    """Percent of estimated tokens that the short texts save."""
    est = lambda c: F.sum(F.greatest(F.lit(1), F.floor(F.length(T.text_or_empty(F.col(c))) / 4)))
    return df.agg(est(full).alias("full_tokens"), est(short).alias("short_tokens")).withColumn("reduction", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1 - F.col("short_tokens") / F.greatest(F.lit(1), F.col("full_tokens"))))), 4))


def percentiles(df: DataFrame, value: str, by: str) -> DataFrame:
    """Exact interpolated percentiles per group."""
    return df.groupBy(by).agg(*[F.round(F.percentile(value, F.lit(p)), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)])


def failure_cases(docs: DataFrame, text: str, cases: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(case, passed) of (name, expected, banned): all expected words occur somewhere and no banned one does."""
    low = F.lower(T.text_or_empty(F.col(text)))
    words = sorted({w for _, a, b in cases for w in a + b})
    row = docs.agg(*[F.coalesce(F.bool_or(low.contains(w.lower())), F.lit(False)).alias(f"w{i}") for i, w in enumerate(words)])
    at = {w: F.col(f"w{i}") for i, w in enumerate(words)}

    def passed(expected: list[str], banned: list[str]) -> Column:
        ok = F.lit(True)
        for w in expected:
            ok = ok & at[w]
        for w in banned:
            ok = ok & ~at[w]
        return ok

    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("case"), passed(a, b).alias("passed")) for n, a, b in cases])).alias("x")).select("x.*")


def findings(df: DataFrame) -> DataFrame:
    """(id, check, detail) of the integrity checks of items. One scan for row checks, one aggregation for fingerprints.

    Missing embeddings and orphan `item:` references are checked where the table has their columns. Cached files, which lie
    outside the tables, aren't.
    """
    bad = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks = [
        (bad("id") | bad("url") | bad("platform"), "malformed", F.lit(None)),
        (~U.valid_url(F.col("canonical_url")), "invalid_canonical", F.col("canonical_url")),
        (F.col("captured_at").isNull(), "missing_timestamp", F.lit(None)),
        (F.col("capture_debug").isNotNull() & F.try_parse_json("capture_debug").isNull(), "invalid_json", F.col("capture_debug")),
    ]
    if {"embedding_done", "embedding_skipped"} <= {*df.columns}:
        checks.append((~F.coalesce(F.col("embedding_done").cast("boolean"), F.lit(False)) & ~F.coalesce(F.col("embedding_skipped").cast("boolean"), F.lit(False)), "missing_embedding", F.lit(None)))
    for c, kind in df.dtypes:
        if kind == "string" and c in ("related_topics", "related_entities", "quality_flags", "sensitivity_reasons"):
            checks.append(((F.col(c) != "") & ~F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("ARRAY"), F.lit(False)), "invalid_json_list", F.lit(c)))
    each = F.explode(F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(n).alias("check"), d.cast("string").alias("detail"))) for hit, n, d in checks])))
    rows = df.select("id", each.alias("x")).select("id", "x.check", "x.detail")
    first = df.filter(~bad("dedupe_key")).groupBy("dedupe_key").agg(F.min(F.struct("captured_at", "id")).alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("dedupe_key", F.col("v.id").alias("first"))
    repeated = df.select("id", "dedupe_key").join(first, "dedupe_key").filter("id <> first").select("id", F.lit("duplicate_fingerprint").alias("check"), F.concat("first", F.lit(":"), "id").alias("detail"))
    out = rows.unionByName(repeated)
    if "source_context" in df.columns:
        ref = F.trim(F.substring("source_context", 6, 2**31 - 1))
        refs = df.filter(F.col("source_context").startswith("item:")).select("id", ref.alias("detail")).filter("detail <> ''")
        out = out.unionByName(refs.join(df.select(F.col("id").alias("detail")), "detail", "left_anti").select("id", F.lit("orphan_relationship").alias("check"), "detail"))
    return out


def repaired(df: DataFrame) -> DataFrame:
    """(id, canonical_url, dedupe_key) with invalid addresses rebuilt and blank fingerprints filled."""
    platform = U.detect_platform(F.col("url"), F.col("platform"))
    canonical = F.when(U.valid_url(F.col("canonical_url")), F.col("canonical_url")).otherwise(U.canonical_url(F.col("url"), platform))
    made = C.fingerprint(canonical, platform, F.col("text_content"), F.coalesce("author_name", "author"), C.time_bucket(F.col("captured_at")))
    return df.select("id", canonical.alias("canonical_url"), F.coalesce(F.nullif(F.trim("dedupe_key"), F.lit("")), made).alias("dedupe_key"))
