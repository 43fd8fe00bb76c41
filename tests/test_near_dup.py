import random
from datetime import datetime as D, timedelta

from recolta.operators import near_dup as N
from recolta.plans import core_queries as C

ROW = "id string, platform string, namespace string, captured_at timestamp, text_content string"


def rows(n):
    rng = random.Random(4)
    words = "docker tip of the day prune your images before a long build and check memory again".split()
    out = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice((4, 12, 45))))
        if out and rng.random() < 0.5:  # a changed copy of an earlier row
            text = " ".join(rng.choice(words) if rng.random() < 0.1 else w for w in (rng.choice(out[-30:])[4] or "x").split())
        at = None if k == 5 else D(2026, 1, 1) + timedelta(minutes=30 * (k // 4 + rng.randrange(3)))
        out.append((f"i{k:04d}", rng.choice(("twitter", " Twitter", "youtube")), rng.choice((None, "default", "work")), at, rng.choice((text, text, text, text.upper(), None)) if k % 9 == 0 else text))
    return out


def test_each_row_against_the_rows_before(spark):
    data, recent, want = rows(700), 12, {}
    groups = {}
    for r in sorted(data, key=lambda r: (r[3] or D(1, 1, 1), r[0])):
        before = groups.setdefault((r[1].strip().lower(), r[2] or "default"), [])
        hit = next(((o[0], v) for o in before[: -recent - 1 : -1] if (v := N.similarity(r[4] or "", o[4] or "")) >= 0.82), None)
        if hit:
            want[r[0]] = (hit[0], round(hit[1], 6))
        before.append(r)
    got = N.near_duplicates_within(spark.createDataFrame(data, ROW), 0.82, recent).collect()
    assert len(want) > 50 and len(got) == len(want) and {r.id: (r.duplicate_of, r.ratio) for r in got} == want


def test_query_sees_all_months(spark, tmp_path):
    text = "docker tip of the day: prune your images"
    data = [("a", "x", None, D(2026, 2, 1), text), ("b", "x", None, D(2026, 2, 2), text), ("c", "x", None, D(2026, 6, 2), text + "!"), ("d", "x", None, D(2026, 6, 3), text)]
    spark.createDataFrame(data, ROW).write.parquet(f"{tmp_path}/items.parquet")
    got = {r.id: r.duplicate_of for r in C.near_dup_similarity(spark, str(tmp_path)).collect()}
    assert got == {"b": "a", "c": "b", "d": "c"}
