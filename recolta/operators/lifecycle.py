"""The memory lifecycle: event folds, nodes, relations, conflicts and the edge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from recolta.functions import scores as S, text as T
from recolta.operators.skew import broadcast_if_small
from recolta.session import materialize

# Words that mark a contradiction.
MARKERS = (" but ", " however ", " contradict", " conflict", " changed ")
#: State that each event leaves behind; others leave none.
STATE_OF = {"capture": "captured", "normalize": "normalized", "summarize": "summarized", "index": "indexed", "reinforce": "reinforced", "decay": "decaying", "archive": "archived", "forget": "forgotten"}


def clean_events(events: DataFrame) -> DataFrame:
    """Events once each (delivery repeats rows), with the payload's amount; a broken payload has none."""
    amount = F.try_variant_get(F.try_parse_json("payload"), "$.amount", "double")
    return events.groupBy("event_id").agg(F.min(F.struct("created_at", "memory_id", "event_type", "payload")).alias("v")).select("event_id", "v.*").withColumn("amount", amount)


def _clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def fold(events: DataFrame) -> DataFrame:
    """(memory_id, state, reinforcement, events, first_at, last_at): the fold of each memory's events.

    Reinforcement adds the amount of reinforce events, clamped to 0..10 after each step in order of time.
    Clamped steps compose: a run of steps is x -> min(high, max(low, x + add)), a triple of numbers, and
    two runs make one. So events are folded by hour in parallel and the hours' triples are folded per
    memory, and no task holds a whole memory's log unless all of it lies in one hour.
    """
    ev = clean_events(events).filter(F.col("memory_id").isNotNull())
    step = F.when(F.col("event_type") == "reinforce", _clamped(F.coalesce("amount", F.lit(0.1)), -1.0, 1.0)).otherwise(0.0)
    item = F.struct("created_at", "event_id", step.alias("step"), "event_type")
    hourly = ev.groupBy("memory_id", F.date_trunc("hour", "created_at").alias("hour")).agg(F.array_sort(F.collect_list(item)).alias("e"), F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    start = F.struct(F.lit(0.0).alias("add"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    one = lambda s, a: F.struct((s["add"] + a).alias("add"), _bounded(s["low"] + a).alias("low"), _bounded(s["high"] + a).alias("high"))
    triple = F.aggregate("e", start, lambda s, x: one(s, x["step"]))
    stated = F.filter("e", lambda x: x["event_type"].isin(*STATE_OF))
    folded = hourly.select("memory_id", "hour", "n", "first_at", "last_at", triple.alias("t"), F.try_element_at(stated, F.lit(-1)).alias("last"))
    runs = folded.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("hour", "t"))).alias("r"), F.sum("n").alias("events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max(F.when(F.col("last").isNotNull(), F.struct("last.created_at", "last.event_id", "last.event_type"))).alias("last"))
    value = F.aggregate("r", F.lit(0.0), lambda x, h: F.greatest(h["t"]["low"], F.least(h["t"]["high"], x + h["t"]["add"])))
    state = F.lit(None).cast("string")
    for name, s in STATE_OF.items():
        state = F.when(F.col("last.event_type") == name, s).otherwise(state)
    return runs.select("memory_id", state.alias("state"), F.round(value, 6).alias("reinforcement"), "events", "first_at", "last_at")


def _bounded(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), c))


NODE = ["updated_at", "created_at", "state", "decay_score", "reinforcement", "importance_score", "last_accessed_at", "forgotten_at", "namespace"]


def valid_nodes(nodes: DataFrame, namespace: str) -> DataFrame:
    """One row per memory of a namespace: the one changed last, ties going to the greatest values in the order of NODE."""
    last = nodes.filter(F.col("memory_id").isNotNull()).groupBy("memory_id").agg(F.max(F.struct(*NODE)).alias("v")).select("memory_id", "v.*")
    return last.filter(F.coalesce("namespace", F.lit("default")) == namespace)


def heatmap(nodes: DataFrame, namespace: str) -> DataFrame:
    """(day, state, memories, mean_reinforcement, mean_decay) per UTC day of creation and state of the namespace's memories."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)).cast("decimal(18,10)"), 6).cast("double")
    by = valid_nodes(nodes, namespace).groupBy(F.to_date("created_at").alias("day"), "state")
    return by.agg(F.count(F.lit(1)).alias("memories"), mean("reinforcement").alias("mean_reinforcement"), mean("decay_score").alias("mean_decay"))


def aging(nodes: DataFrame, namespace: str, limit: int = 200) -> DataFrame:
    """The memories of a namespace that changed last, with what is to be done with each; a top-k."""
    score = F.coalesce("decay_score", F.lit(0.0))
    top = valid_nodes(nodes, namespace).orderBy(F.desc("updated_at"), "memory_id").limit(limit)
    return top.select("memory_id", "state", F.round(score, 6).alias("decay_score"), F.round(F.coalesce("reinforcement", F.lit(0.0)), 6).alias("reinforcement"), F.round(F.coalesce("importance_score", F.lit(0.0)), 6).alias("importance_score"), "last_accessed_at", "forgotten_at", "updated_at", S.next_action(score, F.col("state")).alias("next_action"))


def recent_graph(nodes: DataFrame, edges: DataFrame, namespace: str, limit: int = 300) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the memories of a namespace changed last, and the edges made last, of all namespaces; both are top-k."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    own = valid_nodes(nodes, namespace).orderBy(F.desc("updated_at"), "memory_id").limit(limit)
    made = edges.select("edge_id", "from_memory_id", "to_memory_id", "relation", "confidence", "created_at").distinct().orderBy(F.desc("created_at"), "edge_id").limit(limit)
    return own.select("memory_id", "state", zero("reinforcement"), zero("decay_score"), zero("importance_score")), made.select("edge_id", "from_memory_id", "to_memory_id", "relation", zero("confidence"))


def latest(events: DataFrame, nodes: DataFrame, namespace: str, limit: int = 200) -> DataFrame:
    """The newest events of the namespace's memories."""
    own = nodes.filter(F.coalesce("namespace", F.lit("default")) == namespace).select("memory_id").distinct()
    return clean_events(events).join(own, "memory_id", "left_semi").orderBy(F.desc("created_at"), "event_id").limit(limit).select("event_id", "memory_id", "event_type", "created_at")


def nodes_of(items: DataFrame, as_of: str) -> DataFrame:
    """A memory node for each enriched item, summarised in three lengths and decayed."""
    text = F.col("text_content")
    node = items.select(F.concat(F.lit("mem:"), "id").alias("memory_id"), F.col("id").alias("item_id"), F.coalesce("namespace", F.lit("default")).alias("namespace"), S.lifecycle_type(F.col("tags"), text).alias("memory_type"), T.clip(text, 180).alias("summary_short"), T.clip(text, 420).alias("summary_medium"), T.clip(text, 560).alias("summary_long"), T.py_or(F.col("capture_confidence"), 1.0).alias("confidence"), F.coalesce("importance_score", F.lit(0.0)).alias("importance_score"), "decay_score", "aging_state")
    return node.withColumn("state", F.when(F.col("aging_state") == "archived", "archived").otherwise("decaying")).withColumn("next_action", S.next_action(F.col("decay_score"), F.col("state")))


def forget(nodes: DataFrame, as_of: str) -> DataFrame:
    """Nodes with decay of 0.97 or more that are not forgotten yet become so."""
    due = F.col("forgotten_at").isNull() & (F.col("decay_score") >= 0.97)
    return nodes.withColumn("state", F.when(due, "forgotten").otherwise(F.col("state"))).withColumn("forgotten_at", F.when(due, S.instant(as_of)).otherwise(F.col("forgotten_at")))


def resolve_conflicts(conflicts: DataFrame) -> DataFrame:
    """Of two values the surer one, if the confidences differ by 0.25 or more; else the conflict stays open."""
    clear = F.abs(F.col("confidence_a") - F.col("confidence_b")) >= 0.25
    return conflicts.withColumn("resolved_value", F.when(clear, F.when(F.col("confidence_a") >= F.col("confidence_b"), F.col("value_a")).otherwise(F.col("value_b")))).withColumn("status", F.when(clear, "resolved").otherwise("open"))


def relations(items: DataFrame, candidates: int = 40) -> DataFrame:
    """(from_id, to_id, relation, confidence): each item against the newest other items of its namespace.

    The candidates are the same few rows for all items of a namespace: a top-k per namespace, joined
    as one array (by broadcast while all arrays together are small), so nothing is paired by a join of rows.
    """
    low = F.lower(T.text_or_empty(F.col("text_content")))
    ns = F.coalesce("namespace", F.lit("default"))
    base = items.select("id", ns.alias("ns"), "captured_at", low.alias("text"), F.transform("related_entities", F.lower).alias("entities"), F.col("related_topics").alias("topics"), "semantic_group")
    recent = base.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.desc("captured_at"), F.col("id")]
    for keys in (["ns", "part"], ["ns"]):  # in two steps, so that no task sorts a whole namespace
        recent = recent.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= candidates + 1)
    lists = recent.groupBy("ns").agg(F.array_sort(F.collect_list(F.struct("n", "id", "text"))).alias("c"))
    lists = materialize(lists, "relation-candidates")
    near = broadcast_if_small(lists, F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + 64 + F.length(x["text"])))
    pairs = base.join(near, "ns").select("id", "text", "entities", "topics", "semantic_group", F.explode(F.slice(F.filter("c", lambda x: x["id"] != F.col("id")), 1, candidates)).alias("o"))
    other = F.col("o.text")
    shared = F.exists("entities", lambda e: other.contains(e))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.concat("text", F.lit(" "), other).contains(m)
    relation = F.when(F.col("semantic_group").isNotNull() & other.contains(F.col("semantic_group")), "same_as").when(shared & marked, "contradicts").when(shared | F.exists("topics", lambda t: other.contains(t)), "supports")
    found = pairs.select(F.col("id").alias("from_id"), F.col("o.id").alias("to_id"), relation.alias("relation")).filter(F.col("relation").isNotNull())
    return found.withColumn("confidence", F.when(F.col("relation") == "same_as", 0.86).when(F.col("relation") == "contradicts", 0.72).otherwise(0.66))


def degrees(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(memory_id, out_edges, in_edges) of the edge list, each edge once; the busiest if limit is given."""
    once = edges.select("edge_id", "from_memory_id", "to_memory_id").distinct()
    ends = once.select(F.col("from_memory_id").alias("memory_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(once.select("to_memory_id", F.lit(0), F.lit(1)))
    out = ends.filter(F.col("memory_id").isNotNull()).groupBy("memory_id").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))
    return out if limit is None else out.orderBy(F.desc(F.col("out_edges") + F.col("in_edges")), "memory_id").limit(limit)


def merge(primary: DataFrame, as_of: str, confidence: float = 0.8) -> DataFrame:
    """same_as edges and merge events for pairs (primary_id, secondary_id)."""
    made = F.concat_ws("|", "primary_id", "secondary_id", F.lit(as_of))
    return primary.select(F.sha2(made, 256).alias("edge_id"), F.col("primary_id").alias("from_memory_id"), F.col("secondary_id").alias("to_memory_id"), F.lit("same_as").alias("relation"), F.lit(confidence).alias("confidence"), S.instant(as_of).alias("created_at"))
