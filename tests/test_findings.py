from datetime import datetime as D

from recolta.operators import analytics as A
from recolta.plans import core_queries as C

ROW = "id string, url string, canonical_url string, platform string, captured_at timestamp, dedupe_key string, capture_debug string"


def test_all_checks_with_their_rows(spark, tmp_path):
    at, u = D(2026, 1, 1), "https://a.example/1"
    data = [("a", u, u, "x", at, "k", "{}"), ("b", u, u, "x", D(2026, 1, 2), "k", None), ("c", " ", u, "x", at, None, "[1]"), ("d", u, "nowhere", "x", at, "", "{bad"), ("e", u, u, "x", None, None, None)]
    df = spark.createDataFrame(data, ROW)
    df.write.parquet(f"{tmp_path}/items.parquet")
    want = {("b", "duplicate_fingerprint", "a:b"), ("c", "malformed", None), ("d", "invalid_canonical", "nowhere"), ("d", "invalid_json", "{bad"), ("e", "missing_timestamp", None)}
    assert {tuple(r) for r in C.verify_findings(spark, str(tmp_path)).select("id", "check", "detail").collect()} == want
    more = df.selectExpr("*", "id = 'a' AS embedding_done", "id > 'b' AS embedding_skipped", "if(id = 'a', 'item: zz', 'item:a') AS source_context", "if(id = 'e', '{}', '[]') AS quality_flags")
    extra = {("b", "missing_embedding", None), ("a", "orphan_relationship", "zz"), ("e", "invalid_json_list", "quality_flags")}
    assert {tuple(r) for r in A.findings(more).collect()} == want | extra
