import random
from datetime import datetime as D, timedelta

from pyspark.sql import functions as F

from recolta.config import EngineConfig
from recolta.operators import analytics as A, extract as X, items as I, lifecycle as L, near_dup as N, search as R
from recolta.streaming import sequential as Q

CFG = EngineConfig()
ITEM = "id string, url string, canonical_url string, platform string, content_type string, text_content string, author string, author_name string, image_urls array<string>, tags array<string>, captured_at timestamp, archived_at timestamp, namespace string, heat double, dwell_seconds double, surfaced_count int, starred boolean, capture_confidence double, semantic_group string, dedupe_key string"


def item(i, text, **kw):
    row = {"id": i, "url": f"https://x.com/a/status/{i}", "canonical_url": None, "platform": "twitter", "content_type": "post", "text_content": text, "author": "Ann", "author_name": None, "image_urls": [], "tags": [], "captured_at": D(2026, 6, 1), "archived_at": None, "namespace": None, "heat": 1.0, "dwell_seconds": 0.0, "surfaced_count": 0, "starred": False, "capture_confidence": 0.9, "semantic_group": None, "dedupe_key": None} | kw
    return tuple(row[c.split()[0]] for c in ITEM.split(", "))


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def test_hybrid_search(spark):
    df = items(spark, item("1", "docker tip same post"), item("2", "docker tip same post", url="https://x.com/a/status/1"), item("3", "docker in the kitchen", platform="youtube", url="https://y.com/3"), item("4", "docker secret", archived_at=D(2026, 6, 2)), item("5", "docker other", namespace="work"), item("6", None), item("7", ""))
    got = R.hybrid(df, "docker", CFG, 10).collect()
    assert {r.id for r in got} >= {"1", "2", "3"} and not {"4", "5"} & {r.id for r in got}
    assert any(r.trace.duplicate > 0 for r in got) and [r.position for r in got] == list(range(1, len(got) + 1)) and got[0].matched == ["text_content", "related_topics"]
    assert R.hybrid(df, "  ", CFG).count() == 0 and R.hybrid(df.limit(0), "docker", CFG).count() == 0
    lines = R.rag_context(R.hybrid(df, "docker", CFG), "position", EngineConfig(context_chars=500)).collect()
    assert lines[0].line.startswith("[1] (") and sum(len(x.line) + 1 for x in lines) - 1 <= 500
    assert R.feed(I.enrich(df, CFG), CFG, "explore", 3).count() == 3 and R.resurface(df, "docker", CFG, 2, "1").count() == 2


def test_text_distance_equals_vectors(spark):
    df = items(spark, item("1", "docker tip same post docker"), item("2", "kitchen sink"), item("3", None), item("4", "docker"))
    q = R.hash_embedding(items(spark, item("q", "docker post")), "id", "text_content").first().vector
    a, b = ({r.id: round(r.distance, 9) for r in x.collect()} for x in (R.nearest(R.hash_embedding(df, "id", "text_content"), "id", "vector", q), R.nearest_text(df, "id", "text_content", q)))
    assert a == b


def test_bm25_odd_queries(spark):
    df = items(spark, item("1", "a-b c"), item("2", "ünïcode Ünïcode"))
    assert R.bm25(df, "id", ["text_content"], '"; DROP -- *').count() == 0 and R.bm25(df, "id", ["text_content"], "").count() == 0
    assert [r.id for r in R.bm25(df, "id", ["text_content"], "ÜNÏCODE").collect()] == ["2"] and [r.id for r in R.phrase(df, "id", ["text_content"], "b c").collect()] == ["1"]


def test_insert_patch_and_marks(spark):
    old = items(spark, item("1", "a", dedupe_key="k1"), item("2", "b"))
    new = items(spark, item("3", "a", dedupe_key="k1"), item("4", "c", dedupe_key="k2"), item("5", "c", dedupe_key="k2", captured_at=D(2026, 5, 1)), item("2", "b"), item("6", "d"))
    rows, report = I.insert_ignore(old, new)
    assert {r.id for r in rows.collect()} == {"5", "6"}
    assert {r.id: r.existing_id for r in report.collect()} == {"3": "1", "4": "5", "5": None, "2": "2", "6": None}
    patched = I.patch(old, spark.createDataFrame([("1", "new", None), ("9", "x", 1.0)], "id string, author string, heat double"))
    assert {(r.id, r.author, r.heat) for r in patched.collect()} == {("1", "new", 1.0), ("2", "Ann", 1.0)}
    assert {r.heat for r in I.bump_heat(old, spark.createDataFrame([("1", 6.0), ("1", 6.0)], "id string, amount double")).collect()} == {10.0, 1.0}
    kept = I.keep_first(new, ["dedupe_key"], [F.col("captured_at"), F.col("id")])
    assert {r.id for r in kept.collect()} == {"3", "5", "2", "6"}
    files = spark.createDataFrame([(str(i), 10, D(2026, 1, 1 + i // 2, i % 2)) for i in range(6)], "path string, size int, mtime timestamp")
    assert {r.path for r in I.within_quota(files, 35).filter("keep").collect()} == {"5", "4", "3"}


def test_fold_equals_plain_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    for m in range(6):
        events = sorted((D(2026, 1, 1) + timedelta(minutes=rng.randrange(6000)), f"e{m}-{k:03d}", rng.choice(["reinforce", "reinforce", "decay", "conflict"]), rng.choice([5.0, -0.7, 0.4, None])) for k in range(40))
        x, state = 0.0, None
        for at, e, kind, amount in events:
            if kind == "reinforce":
                x = min(10.0, max(0.0, x + min(1.0, max(-1.0, 0.1 if amount is None else amount))))
            state = L.STATE_OF.get(kind, state)
            rows.append((e, f"m{m}", kind, "{bad" if amount is None else f'{{"amount": {amount}}}', at))
        want[f"m{m}"] = (state, round(x, 6), 40)
    rows += rows[:9] + [("z", None, "decay", None, D(2026, 1, 1))]
    rng.shuffle(rows)
    got = L.fold(spark.createDataFrame(rows, "event_id string, memory_id string, event_type string, payload string, created_at timestamp"))
    assert {r.memory_id: (r.state, r.reinforcement, r.events) for r in got.collect()} == want
    assert L.fold(spark.createDataFrame([], "event_id string, memory_id string, event_type string, payload string, created_at timestamp")).count() == 0


def test_relations_and_graph(spark):
    df = I.enrich(items(spark, item("1", "talk about kubernetes with @bob"), item("2", "kubernetes is fun", captured_at=D(2026, 6, 3)), item("3", "@bob changed plans however", captured_at=D(2026, 6, 4)), item("4", "nothing else")), CFG)
    got = {(r.from_id, r.to_id): r.relation for r in L.relations(df).collect()}
    assert got[("1", "2")] == "supports" and got[("1", "3")] == "contradicts" and ("4", "1") not in got
    edges = spark.createDataFrame([("e", "a", "b"), ("e", "a", "b"), ("f", "a", None)], "edge_id string, from_memory_id string, to_memory_id string")
    assert {tuple(r) for r in L.degrees(edges).collect()} == {("a", 2, 0), ("b", 0, 1)}
    c = spark.createDataFrame([("x", "y", 0.9, 0.5), ("x", "y", 0.5, 0.6)], "value_a string, value_b string, confidence_a double, confidence_b double")
    assert [(r.resolved_value, r.status) for r in L.resolve_conflicts(c).collect()] == [("x", "resolved"), (None, "open")]


def test_near_duplicates(spark):
    old = items(spark, item("1", "Docker tip of the day: prune your images"), item("2", None), item("3", "x"))
    new = items(spark, item("9", "docker tip of the day - prune your images!"), item("8", "totally different words"), item("7", None), item("6", "docker tip of the day: prune your images", platform="youtube"))
    assert [(r.id, r.duplicate_of) for r in N.near_duplicates(old, new).collect()] == [("9", "1")]


PAGE = "<html><head><link rel='canonical' href='https://s.example/p/1'></head><body><article class='post main'><img src='https://i.example/1.png'><a class=author href='/u/ann'>Ann  B</a><div id=t><p>Hello <b>big</b> world</p></div></article></body></html>"


def test_extraction(spark):
    config = {"text_selectors": ["article.main #t p"], "author_selectors": [".missing", "a[class=author]"], "canonical_url_selectors": ["link[rel*='canon']"], "media_selectors": ["img[src^='https']"], "fallback_selectors": {"author_handle": ["a"]}}
    rows = {r.id: r for r in X.extract(spark.createDataFrame([("1", PAGE), ("2", None), ("3", "<p>")], "id string, html string"), "id", "html", config).collect()}
    assert rows["1"].text_content == "Hello big world" and rows["1"].author_name == "Ann B" and rows["1"].canonical_url == "https://s.example/p/1" and rows["1"].media_urls == ["https://i.example/1.png"] and rows["1"].quality_flags == []
    assert "missing_text" in rows["2"].quality_flags and rows["3"].media_urls == []


def test_state_machines(spark):
    at = D(2026, 1, 1)
    rows = [("a", at + timedelta(seconds=s), i, ok) for i, (s, ok) in enumerate([(0, True), (1, False), (2, False), (3, True), (70, True)])] + [(None, at, 9, True)]
    df = spark.createDataFrame(rows, "k string, t timestamp, n int, ok boolean")
    run = lambda m, ok=None: {r.n for r in Q.admit(df, "k", "t", "n", m, ok).filter("admitted").collect()}
    assert run(lambda: Q.SlidingLog(2, 60)) == {0, 1, 4, 9} and run(lambda: Q.Breaker(2, 60), "ok") == {0, 1, 2, 4, 9} and run(lambda: Q.Debounce(2)) == {0, 4, 9}


def test_analytics(spark):
    df = spark.createDataFrame([("q", 1, True, "abcd"), ("q", 2, False, ""), ("q", 6, True, "x" * 40)], "query string, rank int, relevant boolean, text string")
    r = A.rank_metrics(df).first()
    assert (r.precision_at_k, r.hit_quality, r.tokens) == (0.5, round((1 + 1 / 6) / (1 + 1 / 2 + 1 / 6), 6), 11)
    m = spark.createDataFrame([("t", 100, 94, 3, 2), ("z", 0, 0, 0, 0)], "platform string, attempts int, stored int, duplicates int, missing int")
    assert {(r.platform, r.success_rate, r.duplicate_rate) for r in A.capture_reliability(m).collect()} == {("t", 0.94, 0.03), ("z", 0.0, 0.0)}
