"""Scans, filters, enrichment and row-level changes of the items table.

Changes never happen in place: each gives a new snapshot DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from recolta.config import EngineConfig
from recolta.functions import classify as C, scores as S, text as T, urls as U


def in_namespace(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Rows of the namespace; null is 'default'."""
    return df.filter(F.coalesce("namespace", F.lit("default")) == cfg.namespace)


def visible(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Rows neither archived nor, if configured, hidden."""
    out = df.filter(F.col("archived_at").isNull())
    return out.filter(~F.coalesce("search_hidden", F.lit(False))) if cfg.hide_sensitive and "search_hidden" in df.columns else out


def since(df: DataFrame, days_back: int | None, cfg: EngineConfig) -> DataFrame:
    """Rows captured in the last days; a null time stays."""
    if days_back is None:
        return df
    return df.filter(F.col("captured_at").isNull() | (F.col("captured_at") >= S.instant(cfg.as_of) - F.make_dt_interval(F.lit(days_back))))


def newest(df: DataFrame, limit: int | None = None, offset: int = 0, platform: str | None = None, starred: bool = False) -> DataFrame:
    """Newest rows first, a page of them if limit is given."""
    out = df.filter(U.platform_name(F.col("platform")) == platform) if platform else df
    out = out.filter("starred") if starred else out
    out = out.orderBy(F.desc("captured_at"), "id")
    return out.offset(offset).limit(limit) if limit is not None else out


def on_day(df: DataFrame, day: str, platform: str | None = None) -> DataFrame:
    """Rows of one UTC day, as a range so that it reaches the file scan."""
    start = F.to_timestamp(F.lit(day))
    out = df.filter((F.col("captured_at") >= start) & (F.col("captured_at") < start + F.make_dt_interval(F.lit(1))))
    return out.filter(U.platform_name(F.col("platform")) == platform) if platform else out


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ids."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def excerpt(c: Column, size: int = 200) -> Column:
    return F.substring(F.trim(T.text_or_empty(c)), 1, size)


def thumbnail(images: Column) -> Column:
    first = F.try_element_at(images, F.lit(1))
    return F.when(first.rlike("^(https?://|/images/|/api/images/)"), first)


def matched_fields(query: str, text: Column, author: Column, url: Column, topics: Column) -> Column:
    """Names of the fields that contain the query."""
    q = query.lower()
    holds = lambda c: F.lower(T.text_or_empty(c)).contains(q)
    hits = [(holds(text), "text_content"), (holds(author), "author"), (holds(url), "canonical_url"), (F.exists(topics, lambda t: t.contains(q)), "related_topics")]
    return F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, n in hits])) if q else F.array().cast("array<string>")


def enrich(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """All derived columns of an item, in one projection chain without any shuffle."""
    text, url = F.col("text_content"), F.col("url")
    noise, noise_reason = C.noise(text, F.col("image_urls"))
    risk, risk_reason = C.prompt_risk(text)
    level, level_reasons = C.sensitivity(text, url)
    out = df.withColumns({
        "platform": U.platform_name(F.col("platform")),
        "canonical_url": F.coalesce(F.nullif(F.trim("canonical_url"), F.lit("")), U.canonical_url(url, F.col("platform"))),
        "related_topics": T.topics(text),
        "related_entities": T.entities(text),
        "noise_score": noise,
        "noise_reason": noise_reason,
        "prompt_risk_score": risk,
        "prompt_risk_reason": risk_reason,
        "sensitivity_level": level,
        "sensitivity_reasons": level_reasons,
        "memory_type": S.memory_type(F.col("tags"), text, F.col("content_type")),
    })
    out = out.withColumns({
        "semantic_group": F.coalesce("semantic_group", T.semantic_group(F.col("related_topics"), F.col("related_entities"))),
        "search_hidden": F.col("sensitivity_level") == "high",
        "decay_score": S.decay(F.col("captured_at"), F.col("surfaced_count"), F.col("heat"), F.col("starred"), F.col("memory_type"), cfg.as_of, cfg.half_life_days),
    })
    made = S.primitives(F.col("captured_at"), F.col("capture_confidence"), F.col("starred"), F.col("heat"), F.col("decay_score"), F.col("surfaced_count"), cfg.as_of)
    return out.withColumns(made | {"aging_state": S.aging_state(F.col("decay_score"), F.col("archived_at"))})


def auto_archive(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Old rows of low importance get an archive time and reason; both stay where they exist."""
    due = F.col("captured_at").isNotNull() & (S.age_days(F.col("captured_at"), cfg.as_of) >= max(1, cfg.retention_days)) & (F.col("importance_score") <= cfg.low_score)
    reason = F.col("archive_reason") if "archive_reason" in df.columns else F.lit(None).cast("string")
    return df.withColumn("archive_reason", F.when(due, F.coalesce(reason, F.lit(f"retention:auto_archive:{cfg.retention_days}d"))).otherwise(reason)).withColumn("archived_at", F.when(due, F.coalesce("archived_at", S.instant(cfg.as_of))).otherwise(F.col("archived_at")))


def heat_decay(df: DataFrame, cfg: EngineConfig, factor: float = 0.95, idle_days: int = 7) -> DataFrame:
    """Heat of rows idle for long shrinks, to 0.05 at least."""
    seen = F.coalesce(F.col("last_surfaced"), F.col("captured_at")) if "last_surfaced" in df.columns else F.col("captured_at")
    idle = F.col("archived_at").isNull() & (seen < S.instant(cfg.as_of) - F.make_dt_interval(F.lit(idle_days)))
    return df.withColumn("heat", F.when(idle, F.greatest(F.lit(0.05), F.col("heat") * factor)).otherwise(F.col("heat")))


def bump_heat(df: DataFrame, bumps: DataFrame, cap: float = 10.0) -> DataFrame:
    """bumps (id, amount): amounts of an id add up, heat stays within cap. Amounts are positive."""
    total = bumps.groupBy("id").agg(F.sum("amount").alias("_add"))
    return df.join(total, "id", "left").withColumn("heat", F.when(F.col("_add").isNull(), F.col("heat")).otherwise(F.least(F.lit(cap), F.coalesce("heat", F.lit(1.0)) + F.col("_add")))).drop("_add")


def mark_surfaced(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Surfaced count goes up by one, heat by 0.05, for the given ids."""
    hit = df.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumns({"surfaced_count": F.when(F.col("_hit"), F.coalesce("surfaced_count", F.lit(0)) + 1).otherwise(F.col("surfaced_count")), "heat": F.when(F.col("_hit"), F.least(F.lit(10.0), F.coalesce("heat", F.lit(1.0)) + 0.05)).otherwise(F.col("heat"))}).drop("_hit")


def patch(df: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Non-null fields of patches (one row per key) replace those of df."""
    fields = [c for c in patches.columns if c != key and c in df.columns]
    renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = df.join(renamed, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def archive(df: DataFrame, ids: DataFrame, cfg: EngineConfig) -> DataFrame:
    return patch(df, ids.select("id").distinct().withColumn("archived_at", S.instant(cfg.as_of)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null key all stay."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.filter(known).withColumn("_n", first).filter("_n = 1").drop("_n").unionByName(df.filter(~known))


def first_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, id): the earliest id of each key by (captured_at, id), with partial aggregation, so a hot key is no problem."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("captured_at", "id")).alias("_v")).select(key, F.col("_v.id").alias("id"))


def insert_ignore(stored: DataFrame, new: DataFrame, key: str = "dedupe_key") -> tuple[DataFrame, DataFrame]:
    """(rows to append, report): of new rows those whose id and key are not stored, the earliest of each key.

    report: (id, inserted, existing_id) for every new row; existing_id is the stored or first row of its key.
    """
    known = first_ids(stored, key).withColumnRenamed("id", "_stored")
    mine = first_ids(new, key).withColumnRenamed("id", "_first")
    ids = stored.select(F.col("id").alias("_id")).distinct()
    marked = new.join(known, key, "left").join(mine, key, "left").join(ids, F.col("id") == F.col("_id"), "left")
    ok = F.col("_stored").isNull() & F.col("_id").isNull() & (F.col("_first").isNull() | (F.col("_first") == F.col("id")))
    report = marked.select("id", ok.alias("inserted"), F.when(~ok, F.coalesce("_stored", "_first", "_id")).alias("existing_id"))
    return marked.filter(ok).select(new.columns), report


def from_export(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of export documents with an `items` array of structs: those without url are rejected."""
    each = df.select(F.posexplode("items").alias("position", "item"))
    good = F.col("item").isNotNull() & (F.trim(T.text_or_empty(F.col("item.url"))) != "")
    return each.filter(good).select("item.*"), each.filter(~good).select("position", F.to_json("item").alias("item"))


def to_export(df: DataFrame, version: str = "2") -> DataFrame:
    """Lines of an export, one JSON object per item, so that no task holds them all."""
    return df.select(F.lit(version).alias("schema_version"), F.to_json(F.struct(*df.columns)).alias("item"))


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Older tables: missing columns get their default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def within_quota(files: DataFrame, quota: int) -> DataFrame:
    """(path, keep) of cached files (path, size, mtime): the newest stay while they fit. Running sums per day of
    change come first, so only one day's files meet in a task."""
    day = F.to_date("mtime")
    days = files.groupBy(day.alias("day")).agg(F.sum("size").alias("n"))
    newer = days.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.sum("size").over(W.partitionBy("day").orderBy(F.desc("mtime"), "path").rowsBetween(W.unboundedPreceding, 0))
    return files.withColumn("day", day).join(newer, "day").withColumn("keep", own + F.col("before") <= quota).select("path", "keep")
