"""Scores of memories: decay, ranking primitives, feed and retrieval. as_of is a literal instant."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recolta.functions.text import clamp, py_or, text_or_empty

# Half-life factors by memory type, and words that mark technical posts.
TYPE_FACTOR = {"fact": 1.8, "preference": 1.4, "task": 1.1, "intent": 1.0, "episode": 0.85}
TECHNICAL = ("api", "docker", "kubernetes", "database", "architecture", "python", "typescript")
FRESH = ("latest", "today", "recent", "new", "now")
HABIT = ("preference", "always", "usually", "favorite")


def instant(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def age_days(t: Column, as_of: str) -> Column:
    """Days since an instant, 0 for null and later ones; whole microseconds count."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(instant(as_of)) - F.unix_micros(t)) / F.lit(86_400_000_000.0)), F.lit(0.0))


def _tagged(tags: Column, name: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == name), F.lit(False))


def memory_type(tags: Column, text: Column, kind: Column) -> Column:
    """Type for decay."""
    todo = F.lower(text_or_empty(text)).contains("todo")
    return F.when(_tagged(tags, "fact"), "fact").when(_tagged(tags, "preference"), "preference").when(_tagged(tags, "task") | todo, "task").when(_tagged(tags, "intent"), "intent").when(F.lower(text_or_empty(kind)).isin("video", "image"), "episode").otherwise("ephemeral")


def lifecycle_type(tags: Column, text: Column) -> Column:
    """Type of a memory node."""
    todo = F.lower(text_or_empty(text)).contains("todo")
    return F.when(_tagged(tags, "task") | todo, "task").when(_tagged(tags, "preference"), "preference").when(_tagged(tags, "fact"), "fact").when(_tagged(tags, "intent"), "intent").otherwise("episode")


def decay(captured: Column, surfaced: Column, heat: Column, starred: Column, kind: Column, as_of: str, half_life: int = 90) -> Column:
    """1 - 2^(-age / adjusted half-life), 6 digits."""
    important = (py_or(heat, 1.0) >= 2.5) | F.coalesce(starred, F.lit(False))
    factor = F.lit(0.75)
    for name, f in TYPE_FACTOR.items():
        factor = F.when(kind == name, f).otherwise(factor)
    adjusted = (1.0 + F.least(F.lit(1.5), F.coalesce(surfaced, F.lit(0)) * 0.06) + F.when(important, 0.7).otherwise(0.0)) * factor
    span = F.greatest(F.lit(7.0), F.lit(float(half_life)) * adjusted)
    return F.round(clamp(1.0 - F.pow(F.lit(2.0), -age_days(captured, as_of) / span)), 6)


def aging_state(score: Column, archived: Column) -> Column:
    return F.when(archived.isNotNull(), "archived").when(score >= 0.85, "stale").when(score >= 0.45, "cooling").otherwise("active")


def next_action(score: Column, state: Column) -> Column:
    return F.when(state == "forgotten", "purged").when(score >= 0.97, "forget").when(score >= 0.85, "archive").when(score >= 0.45, "review").otherwise("retain")


def primitives(captured: Column, confidence: Column, starred: Column, heat: Column, decay_score: Column, surfaced: Column, as_of: str) -> dict[str, Column]:
    """importance, resurfacing, recency and recurrence, 6 digits."""
    recency = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), age_days(captured, as_of) / 365.0))
    recurrence = clamp(F.coalesce(surfaced, F.lit(0)) / 10.0)
    importance = clamp(clamp(py_or(confidence, 1.0)) * 0.62 + recency * 0.2 + F.least(F.lit(0.35), py_or(heat, 1.0) * 0.08) + F.when(starred, 0.18).otherwise(0.0) - F.least(F.lit(0.35), F.coalesce(decay_score, F.lit(0.0)) * 0.25))
    resurfacing = clamp(recency * 0.35 + recurrence * 0.45 + importance * 0.2)
    return {"importance_score": F.round(importance, 6), "resurfacing_score": F.round(resurfacing, 6), "recency_score": F.round(recency, 6), "recurrence_score": F.round(recurrence, 6)}


def mode_bonus(mode: str, kind: Column, text: Column, surfaced: Column) -> Column:
    low = F.lower(text_or_empty(text))
    if mode == "focus":
        technical = F.lit(False)
        for t in TECHNICAL:
            technical = technical | low.contains(t)
        return F.when(text_or_empty(kind).isin("article", "post") & technical, 0.2).otherwise(0.05)
    if mode == "light":
        return F.when(text_or_empty(kind).isin("video", "image"), 0.18).otherwise(0.0)
    if mode == "explore":
        return F.greatest(F.lit(0.0), 0.16 - F.log1p(F.coalesce(surfaced, F.lit(0))) * 0.04)
    return F.lit(0.0)


def feed_score(age: Column, untouched: Column, heat: Column, dwell: Column, starred: Column, decay_score: Column, noise_score: Column, bonus: Column) -> tuple[Column, Column, Column]:
    """(score, reason, needs review) of the live feed."""
    h = F.greatest(F.lit(0.05), py_or(heat, 1.0))
    gap = (age >= 3) & (untouched >= 14)
    old = (age >= 30) & (untouched >= 30)
    score = h * 0.68 + 0.2 / (1.0 + age / 14.0) + F.least(F.lit(0.25), F.coalesce(dwell, F.lit(0.0)) / 120.0) + F.when(starred, 0.45).otherwise(0.0) + F.when(gap, 0.18).otherwise(0.0) + bonus
    score = score - F.least(F.lit(0.45), F.coalesce(decay_score, F.lit(0.0)) * 0.4) - F.least(F.lit(0.35), F.coalesce(noise_score, F.lit(0.0)) * 0.35)
    reason = F.when(old, "review_or_archive").when(gap, "worth_resurfacing").when(starred, "starred_memory").when(age < 2, "recent_capture").otherwise("hot_memory")
    return score, reason, old & (h < 0.8)


def library_feed_score(age: Column, untouched: Column, heat: Column, importance: Column, resurfacing: Column, recency: Column, dwell: Column, starred: Column, flags: Column, confidence: Column, bonus: Column) -> tuple[Column, Column, Column]:
    """(score, reason, needs review) of the feed with stored scores."""
    h = F.greatest(F.lit(0.05), py_or(heat, 1.0))
    r = F.when(recency.isNull() | (recency == 0), 1.0 / (1.0 + age / 14.0)).otherwise(recency)
    c = F.when(confidence.isNull(), 0.0).otherwise(confidence)
    missing = F.size(F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: f.startswith("missing_")))
    low = F.greatest(F.lit(0.0), 0.7 - c) * 0.6
    lacking = F.least(F.lit(0.28), missing * 0.08)
    dup = F.when(F.array_contains(flags, "duplicate_risk"), 0.12).otherwise(0.0)
    gap = (age >= 3) & (untouched >= 14)
    imp = F.coalesce(importance, F.lit(0.0))
    score = h * 0.45 + imp * 0.35 + F.coalesce(resurfacing, F.lit(0.0)) * 0.25 + r * 0.15 + F.least(F.lit(0.25), F.coalesce(dwell, F.lit(0.0)) / 120.0) + F.when(starred, 0.45).otherwise(0.0) + F.when(gap, 0.18).otherwise(0.0) + bonus - low - lacking - dup
    reason = F.when(starred, "starred_memory").when((low >= 0.12) | (lacking >= 0.12), "low_confidence_capture").when(gap, "worth_resurfacing").when(r >= 0.85, "recent_capture").otherwise("important_memory")
    return score, reason, ((age >= 30) & (untouched >= 30) & (imp < 0.35)) | (c < 0.45)


def weights(query: str) -> dict[str, float]:
    """Weights of the retrieval score by what the query asks for."""
    q = query.lower()
    base = {"semantic": 0.48, "temporal": 0.18, "importance": 0.16, "context": 0.1, "reliability": 0.08}
    if any(k in q for k in FRESH):
        base = {"semantic": 0.38, "temporal": 0.28, "importance": 0.12, "context": 0.1, "reliability": 0.12}
    elif any(k in q for k in HABIT):
        base = {"semantic": 0.42, "temporal": 0.1, "importance": 0.25, "context": 0.12, "reliability": 0.11}
    return base | {"duplicate": 0.14, "stale": 0.12}


def retrieval_score(query: str, semantic: Column, captured: Column, importance: Column, hay: Column, confidence: Column, duplicate: Column, decay_score: Column, archived: Column, as_of: str, hint: str = "") -> dict[str, Column]:
    """Weighted terms of the retrieval score and their clamped total, unrounded. hay: lower-case text and topics; hint: what
    else the asking context says, which counts for less than the query."""
    w = weights(query)
    q = query.strip().lower()
    temporal = F.when(captured.isNull(), 0.5).otherwise(clamp(1.0 - age_days(captured, as_of) / 365.0))
    said = hint.strip().lower()
    context = (F.when(hay.contains(q), 0.7).otherwise(0.0) if q else F.lit(0.0)) + (F.when(hay.contains(said), 0.3).otherwise(0.0) if said else F.lit(0.0))
    stale = clamp(F.coalesce(decay_score, F.lit(0.0)) + F.when(archived.isNotNull(), 0.25).otherwise(0.0))
    terms = {
        "semantic": w["semantic"] * semantic,
        "temporal": w["temporal"] * temporal,
        "importance": w["importance"] * clamp(F.coalesce(importance, F.lit(0.0))),
        "context": w["context"] * context,
        "reliability": w["reliability"] * clamp(py_or(confidence, 1.0)),
        "duplicate": w["duplicate"] * duplicate,
        "stale": w["stale"] * stale,
    }
    total = terms["semantic"] + terms["temporal"] + terms["importance"] + terms["context"] + terms["reliability"] - terms["duplicate"] - terms["stale"]
    return terms | {"total": clamp(total)}


def additive_rank(base: Column, captured: Column, heat: Column, duplicate: Column, noise_score: Column, confidence: Column, as_of: str) -> Column:
    """Additive ranking of a search hit, 8 digits."""
    recency = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), age_days(captured, as_of) / 365.0))
    c = py_or(confidence, 1.0)
    low = F.when(c >= 0.55, 0.0).otherwise((0.55 - c) * 0.6)
    return F.round(clamp(base) + recency * 0.25 + F.least(F.lit(0.35), py_or(heat, 1.0) * 0.05) - duplicate - F.least(F.lit(0.4), F.coalesce(noise_score, F.lit(0.0)) * 0.5) - low, 8)


def backoff_seconds(attempt: Column, base: float = 0.8, cap: float = 20.0) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def capture_confidence(text: Column, url: Column, author: Column, media: Column, post: Column, flags: Column, fallback_fields: Column, valid: Column) -> tuple[Column, Column]:
    """(confidence, sorted reasons) of a capture by what it lacks."""
    blank = lambda c: F.trim(text_or_empty(c)) == ""
    flags = F.coalesce(flags, F.array().cast("array<string>"))
    checks = [(blank(text), 0.22, "missing_text"), (blank(url), 0.18, "missing_canonical_url"), (blank(author), 0.14, "missing_author"), (F.coalesce(F.size(media), F.lit(0)) <= 0, 0.08, "missing_media"), (blank(post), 0.08, "missing_post_id"), (~valid, 0.12, "weak_canonical_url"), (F.exists(flags, lambda f: f.startswith("missing_")), 0.05, "missing_required_fields"), (F.array_contains(flags, "duplicate_risk"), 0.1, "duplicate_risk")]
    n = F.size(fallback_fields)
    score = F.lit(1.0) - F.least(F.lit(0.18), n * 0.06)
    for hit, w, _ in checks:
        score = score - F.when(hit, w).otherwise(0.0)
    reasons = F.concat(F.array_compact(F.array(*[F.when(h, F.lit(r)) for h, _, r in checks])), F.transform(fallback_fields, lambda f: F.concat(F.lit("fallback_selector_used:"), f)))
    return F.round(clamp(score), 4), F.array_sort(F.array_distinct(reasons))
