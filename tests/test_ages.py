from datetime import datetime as D

from pyspark.sql import functions as F

from recolta.config import EngineConfig
from recolta.functions import scores as S, text as T
from recolta.operators import lifecycle as L, search as R
from recolta.operators.skew import broadcast_if_small

CFG = EngineConfig(as_of="2026-07-01 00:00:00")


def rows(spark, surfaced):
    schema = "id string, namespace string, archived_at timestamp, heat double, captured_at timestamp, content_type string, text_content string, surfaced_count int, dwell_seconds double, starred boolean, decay_score double, noise_score double, platform string"
    df = spark.createDataFrame([("a", None, None, 0.5, D(2026, 1, 1), "post", "x", 0, 0.0, False, 0.0, 0.0, "p")], schema)
    return df if surfaced is None else df.withColumn("last_surfaced", F.lit(surfaced).cast("timestamp"))


def test_feed_counts_from_the_last_surfacing(spark):
    got = [R.feed(rows(spark, x), CFG).first() for x in (None, D(2026, 6, 30))]
    assert [r.surface_reason for r in got] == ["review_or_archive", "hot_memory"] and [r.needs_review for r in got] == [True, False]
    assert abs(got[0].score - got[1].score - 0.18) < 1e-6


def test_context_hint(spark):
    df = spark.createDataFrame([("the garden plan",)], "hay string")
    lit = F.lit(0.0)
    context = lambda q, hint: df.select(S.retrieval_score(q, lit, F.lit(None).cast("timestamp"), lit, F.col("hay"), lit, lit, lit, F.lit(None).cast("timestamp"), CFG.as_of, hint)["context"]).first()[0]
    assert [round(context(q, h) * 100, 6) for q, h in (("garden", ""), ("garden", "Plan"), ("zzz", "plan"), ("", ""))] == [7.0, 10.0, 3.0, 0.0]


def test_accents_are_folded(spark):
    df = spark.createDataFrame([("1", "Un Café noir"), ("2", "cafe"), ("3", "caffè"), ("4", None)], "id string, t string")
    assert {r.id for r in R.bm25(df, "id", ["t"], "cafe", fold=True).collect()} == {"1", "2"}
    assert df.select(T.folded(F.col("t"))).first()[0] == "un cafe noir"


def test_valid_nodes_and_slices(spark):
    schema = "memory_id string, namespace string, state string, decay_score double, reinforcement double, importance_score double, created_at timestamp, updated_at timestamp, last_accessed_at timestamp, forgotten_at timestamp"
    node = lambda i, state, day, ns=None: (i, ns, state, 0.9, None, 0.1, D(2026, 1, 1), D(2026, 1, day), None, None)
    nodes = spark.createDataFrame([node("a", "captured", 2), node("a", "decaying", 5), node("a", "decaying", 5), node("b", "captured", 3), node("c", "captured", 9, "other"), node(None, "x", 9)], schema)
    assert [(r.memory_id, r.state) for r in L.aging(nodes, "default").collect()] == [("a", "decaying"), ("b", "captured")]
    heat = {r.state: (r.memories, r.mean_reinforcement) for r in L.heatmap(nodes, "default").collect()}
    assert heat == {"decaying": (1, 0.0), "captured": (1, 0.0)}
    assert L.aging(nodes.limit(0), "default").count() == 0 and L.heatmap(nodes.limit(0), "default").count() == 0
    edges = spark.createDataFrame([("e", "a", "b", "r", None, D(2026, 1, 1))] * 2, "edge_id string, from_memory_id string, to_memory_id string, relation string, confidence double, created_at timestamp")
    own, made = L.recent_graph(nodes, edges, "default", 1)
    assert [r.memory_id for r in own.collect()] == ["a"] and [r.confidence for r in made.collect()] == [0.0]


def test_broadcast_only_if_small(spark):
    df = spark.createDataFrame([("a" * 100,), (None,)], "t string")
    plan = lambda most: broadcast_if_small(df, F.length("t"), most)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(100) and "broadcast" not in plan(99)
