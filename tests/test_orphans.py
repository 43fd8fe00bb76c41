from datetime import datetime as D

from pyspark.sql import functions as F

from recolta.operators.orphans import orphan_counts, orphan_references

NODES = "memory_id string, item_id string, created_at timestamp, updated_at timestamp, forgotten_at timestamp, reason string"
EDGES = "edge_id string, from_memory_id string, to_memory_id string, created_at timestamp, ref string"


def d(day, month=1):
    return D(2026, month, day)


def made(spark, nodes, edges, items, **kw):
    got = orphan_references(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(items, "id string, captured_at timestamp, known int"), **kw)
    return got


def test_reasons_nulls_ties_and_repeats(spark):
    nodes = [("a", "i1", d(2), d(3), None, "x"), ("a", "i1", d(2), d(9), d(8), "x"), ("a", "i1", d(2), d(9), d(8), "x"), ("b", "", d(5), d(5), None, None), ("c", "nope", d(4), d(4), None, None), ("e", "i2", d(1), d(2), None, None), (None, None, None, None, None, None)]
    edges = [("1", "a", "b", d(7), None), ("1", "a", "b", d(7), None), ("2", "a", "b", d(8), None), ("3", "b", "a", d(3), "z"), ("4", None, "", d(3), None), ("5", "A", "b ", d(3, 2), None), ("6", "b", "a", None, None), (None, "gone", "a", d(7), None)]
    items = [("i1", d(1), 1), ("i1", d(3), 1), ("i2", d(2), 1), (None, d(1), 1)]
    want = {
        ("memory_edges", "from_memory_id", "2", "deleted"), ("memory_edges", "from_memory_id", "3", "late"), ("memory_edges", "from_memory_id", "5", "missing"),
        ("memory_edges", "to_memory_id", "5", "missing"), ("memory_edges", "from_memory_id", None, "missing"), ("memory_nodes", "item_id", "c", "missing"), ("memory_nodes", "item_id", "e", "late"),
    }
    for heavy in (None, 2, 1):
        got = made(spark, nodes, edges, items, heavy_rows=heavy)
        rows = [tuple(r)[:4] for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
    tables = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(items, "id string, captured_at timestamp, known int")
    for heavy in (None, 2, 1):
        counts = {tuple(r) for r in orphan_counts(*tables, heavy_rows=heavy).collect()}
        assert ("memory_edges", "from_memory_id", "missing", "2026-02", 1) in counts
        assert counts == {tuple(r) for r in got.groupBy("src_table", "src_column", "reason", F.date_format("created_at", "yyyy-MM")).count().collect()}


def test_one_key_with_a_million_references(spark):
    nodes = spark.createDataFrame([("hot", None, d(15), d(15), d(20), None)], NODES)
    edges = spark.range(1_000_000).selectExpr("cast(id as string) edge_id", "'hot' from_memory_id", "cast(null as string) to_memory_id", "timestamp'2026-01-01' + make_interval(0, 0, 0, cast(id % 59 as int)) created_at")
    items = spark.createDataFrame([], "id string, captured_at timestamp")
    per_day = {i: len(range(i, 1_000_000, 59)) for i in range(59)}
    want = {("late", "2026-01"): sum(per_day[i] for i in range(14)), ("deleted", "2026-01"): sum(per_day[i] for i in range(19, 31)), ("deleted", "2026-02"): sum(per_day[i] for i in range(31, 59))}
    assert {(r.reason, r.month): r.orphans for r in orphan_counts(nodes, edges, items).collect()} == want
    assert orphan_references(nodes, edges, items).count() == sum(want.values())


def test_empty_tables(spark):
    assert made(spark, [], [], []).count() == 0
    assert made(spark, [], [("1", "a", None, d(1), None)], []).count() == 1
