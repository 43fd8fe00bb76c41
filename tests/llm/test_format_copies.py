import random
from collections import defaultdict

import pyarrow as pa
import pytest

from recolta.llm import format_copies as C

FIELDS = {"url": "url", "dedupe_key": "key"}
SAME = [
    ("https://X.com/a/b", "HTTPS://x.com/A/b/", "url"), ("http://a.b/c?x=1&y=2", "http://a.b/c/?y=2&&x=1#", "url"), (" a\tb\n", "AB", "url"), ("é-Ü", "Éü", "url"),
    ("ns=d;post=1", "POST=1 | NS=D", "key"), ("ab.cd", "'AB-CD'", "key"), ("", " ;", "key"), ("a=1,b=2", "b=2\na=1", "key"),
]
APART = [("a?x=1&y=2", "a?x=2&y=1", "url"), ("a?x=1&x=1", "a?x=1", "url"), ("a;b", "b;a", "key"), ("ab", "ba", "key"), ("a=1;b=2", "a=12;b=", "key"), ("x?b", "b?x", "url"), ("é", "e", "url"), ("", "a", "key")]


def equal_hashes(a, b, kind):
    h = C.rolling_hashes(pa.array([a, b]), kind)
    return all(x[0] == x[1] for x in h)


def test_pairs():
    for a, b, kind in SAME:
        assert equal_hashes(a, b, kind) and C.same_record(a, b, kind) and C._canonical(a, kind) == C._canonical(b, kind)
    for a, b, kind in APART:
        assert not equal_hashes(a, b, kind) and not C.same_record(a, b, kind) and C._canonical(a, kind) != C._canonical(b, kind)


def test_random_agreement():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("aAb?&;=#|, -é") for _ in range(rng.randrange(7))) for _ in "ab")
        for kind in ("url", "key"):
            want = C._canonical(a, kind) == C._canonical(b, kind)
            assert C.same_record(a, b, kind) == want == equal_hashes(a, b, kind), (a, b, kind)


ROWS = [("3", "h://a/?x=1&y=2", "K 1"), ("1", "H://A?y=2&x=1", "k1"), ("2", "h://a?x=1&y=2", "k-1"), ("4", None, "k1"), ("5", "h://a", None), ("6", None, None), ("8", "", ""), ("7", " ", "."), ("9", "u" * 40000, "k"), ("90", "U" * 40000, "k"), ("2", "h://a?x=1&y=2", "k-1")]


def test_copies(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "id string, url string, dedupe_key string, first_id string")
    got = {tuple(r) for r in C.copies(df, "id", FIELDS).collect()}
    assert got == {("1", "2"), ("1", "3"), ("7", "8"), ("9", "90")}
    assert {tuple(r) for r in C.records(df, "id", FIELDS).collect()} == {("1", 4), ("4", 1), ("5", 1), ("6", 1), ("7", 2), ("9", 2)}
    assert C.copies(df.limit(0), "id", FIELDS).count() == 0


def test_lying_hashes_are_split(spark, monkeypatch):
    rows = [(str(i), f"u{i % 3}", "k") for i in range(9)]
    df = spark.createDataFrame(rows, "id string, url string, dedupe_key string")
    plain = C.hashed

    def lie(*a):
        from pyspark.sql import functions as F

        return plain(*a).withColumn("h0", F.lit(1).cast("long")).withColumn("h1", F.lit(1).cast("long"))

    monkeypatch.setattr(C, "hashed", lie)
    groups = defaultdict(set)
    for first, other in C.copies(df, "id", FIELDS).collect():
        groups[first].add(other)
    assert groups == {"0": {"3", "6"}, "1": {"4", "7"}, "2": {"5", "8"}}


@pytest.mark.parametrize("heavy", [1])
def test_heavy_groups(spark, monkeypatch, heavy):
    monkeypatch.setattr(C, "heavy_threshold", lambda n: heavy)
    df = spark.createDataFrame(ROWS, "id string, url string, dedupe_key string")
    assert {tuple(r) for r in C.copies(df, "id", FIELDS).collect()} == {("1", "2"), ("1", "3"), ("7", "8"), ("9", "90")}
