"""References to records that do not exist (problem 3).

Every reference gets the state of its target: 'missing' (no row ever had the key), 'late' (the
target was created after the referring row) or 'deleted' (it was forgotten before). References are
aggregated per key, column and month with their count and the first and last creation time: that decides
all references of a key and month at once, but for those months in which the target was made or forgotten. Only
references with a verdict go back to rows, by broadcast of the verdicts of heavy keys and a shuffle join of all
others, and both results are united. Counts are summed from the aggregates; rows are read for the mixed months only.

Defined cases: null and empty references are no references; keys compare exactly as stored; exact
repeats give one row; of several rows of a memory the one with the latest updated_at is valid, ties
going to the greatest (created_at, forgotten_at, item_id); a null creation time on either side makes neither 'late' nor
'deleted'; if a target is both late and deleted, 'late' is reported. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recolta.operators.skew import heavy_threshold
from recolta.session import materialize


def valid_memories(nodes: DataFrame) -> DataFrame:
    """One row per memory_id: the latest state."""
    latest = F.max(F.struct("updated_at", "created_at", "forgotten_at", "item_id")).alias("v")
    return nodes.filter(F.col("memory_id").isNotNull()).groupBy("memory_id").agg(latest).select("memory_id", "v.item_id", "v.created_at", "v.forgotten_at")


def _references(df: DataFrame, src_table: str, column: str, key: str, kind: str) -> DataFrame:
    present = F.col(column).isNotNull() & (F.col(column) != "")
    return df.filter(present).select(F.lit(src_table).alias("src_table"), F.lit(column).alias("src_column"), F.col(key).alias("src_key"), F.lit(kind).alias("target_kind"), F.col(column).alias("ref"), "created_at")


def references(valid: DataFrame, edges: DataFrame) -> DataFrame:
    """Every reference held by memory_edges and by the valid rows of memory_nodes, valid_memories()."""
    ends = [_references(edges, "memory_edges", c, "edge_id", "memory") for c in ("from_memory_id", "to_memory_id")]
    return ends[0].unionByName(ends[1]).unionByName(_references(valid, "memory_nodes", "item_id", "memory_id", "item"))


def targets(valid: DataFrame, items: DataFrame) -> DataFrame:
    """What can be referred to: memories with creation and forgetting, items with their capture time."""
    memories = valid.select(F.lit("memory").alias("target_kind"), F.col("memory_id").alias("ref"), F.col("created_at").alias("made_at"), F.col("forgotten_at").alias("gone_at"))
    captured = items.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("captured_at").alias("made_at"))
    return memories.unionByName(captured.select(F.lit("item").alias("target_kind"), F.col("id").alias("ref"), "made_at", F.lit(None).cast("timestamp").alias("gone_at")))


KEYS = ["src_table", "src_column", "target_kind", "ref", "period"]


def _by_period(refs: DataFrame) -> DataFrame:
    return refs.withColumn("period", F.date_trunc("month", "created_at"))


def verdicts(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(KEYS, n, reason, made_at, gone_at): for each key, column and month with orphans their count and reason, or
    'mixed' where only some of its references are. The key is joined once per month and column, however many rows it has."""
    per = _by_period(refs).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    joined = per.join(known.withColumn("known", F.lit(True)), ["target_kind", "ref"], "left")
    none_late = F.coalesce(F.col("made_at") <= F.col("first_at"), F.col("made_at").isNull())
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("period").isNull(), F.lit(None))
        .when(F.col("made_at") > F.col("last_at"), "late")
        .when(none_late & (F.col("gone_at").isNull() | (F.col("gone_at") > F.col("last_at"))), F.lit(None))
        .when(none_late & (F.col("gone_at") <= F.col("first_at")), "deleted")
        .otherwise("mixed")
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*KEYS, "n", "reason", "made_at", "gone_at")


def _judged(refs: DataFrame, found: DataFrame, heavy_rows: int) -> DataFrame:
    """The references that have a verdict, with the reason of each. Verdicts of a key, column and month with heavy_rows
    references or more are broadcast; there are at most skew.MOST_HEAVY of those."""
    rows = _by_period(refs)
    same = [rows[c].eqNullSafe(found[c]) if c == "period" else rows[c] == found[c] for c in KEYS]
    facts = [rows[c] for c in rows.columns] + [found[c] for c in ("reason", "made_at", "gone_at")]
    parts = [rows.join(F.broadcast(found.filter(F.col("n") >= heavy_rows)), same).select(*facts), rows.join(found.filter(F.col("n") < heavy_rows), same).select(*facts)]
    reason = F.when(F.col("reason") != "mixed", F.col("reason")).when(F.col("made_at") > F.col("created_at"), "late").when(F.col("gone_at") <= F.col("created_at"), "deleted")
    return parts[0].unionByName(parts[1]).withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("src_table", "src_column", "src_key", "reason", "created_at")


def _prepared(nodes: DataFrame, edges: DataFrame, items: DataFrame, heavy_rows: int | None) -> tuple[DataFrame, DataFrame, int]:
    valid = materialize(valid_memories(nodes), "valid-memories")
    if heavy_rows is None:
        heavy_rows = heavy_threshold(2 * edges.count() + nodes.count())
    return references(valid, edges), targets(valid, items), heavy_rows


def orphan_references(nodes: DataFrame, edges: DataFrame, items: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """(src_table, src_column, src_key, reason, created_at), one row per distinct orphan reference."""
    refs, known, heavy_rows = _prepared(nodes, edges, items, heavy_rows)
    return _judged(refs, materialize(verdicts(refs, known), "verdicts"), heavy_rows).distinct()


def orphan_counts(nodes: DataFrame, edges: DataFrame, items: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """Orphans per table, column, reason and month of the referring row; month is null for a null time. An exact repeat
    of a referring row counts once."""
    refs, known, heavy_rows = _prepared(nodes, edges, items, heavy_rows)
    once = materialize(refs.distinct(), "references")
    found = materialize(verdicts(once, known), "verdicts")
    group = ["src_table", "src_column", "reason"]
    whole = found.filter(F.col("reason") != "mixed").groupBy(*group, F.date_format("period", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"))
    mixed = _judged(once, found.filter(F.col("reason") == "mixed"), heavy_rows).groupBy(*group, F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return whole.unionByName(mixed).groupBy(*group, "month").agg(F.sum("n").alias("orphans"))
