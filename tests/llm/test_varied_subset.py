import hashlib
import random
from collections import Counter

from recolta.llm.varied_subset import choose, fair_share, first_in_group

SCHEMA = "id string, cluster_id string, semantic_group string, platform string, score double, turn int"


def rows():
    rng = random.Random(4)
    out = [(f"h{i}", "big", "g", rng.choice(["twitter", " Twitter "]), 0.1, 0) for i in range(300)]
    out += [(f"t{i}", f"c{i % 70}", f"s{i % 50}", rng.choice(["twitter", "youtube", "tiktok", None]), rng.random(), 0) for i in range(300)]
    return out + [("t1", "c1", "s1", "youtube", 9.0, 0), ("t1", "c1", "s1", "youtube", 9.0, 0), ("n1", None, None, None, None, 0), (None, "x", "y", "z", 1.0, 0)]


def test_even_and_complete(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    keys = {r[0] for r in data} - {None}
    at = {r[0]: r for r in data}
    for k in (0, 1, 4, 40, 200, 601, 5000):
        got = [r.id for r in choose(df, "id", ["cluster_id", "semantic_group", "platform"], k, "score").collect()]
        assert len(got) == len(set(got)) == min(k, len(keys)) and set(got) <= keys
        if k == 40:
            assert max(Counter((at[i][3] or "").strip().lower() for i in got).values()) <= 11  # a cell order has no exact shares of one attribute
            assert Counter(at[i][1] for i in got).most_common(1)[0][1] <= 2 and Counter(at[i][2] for i in got).most_common(1)[0][1] <= 2


def by_sorting(data, k):
    """The named order, by plain loops: rank in the cell, then the ranks of the cell in its cluster, group and platform."""
    value = lambda x: "-" if x is None else "+" + x.strip().lower()
    one = {}
    for i, c, g, p, score, _ in data:
        if i is not None:
            one[i] = max(one.get(i, ()), (float("-inf") if score is None else score, value(c), value(g), value(p)))
    keys = [i for _, i in sorted((int(hashlib.md5(i.encode()).hexdigest()[:15], 16), i) for i in one)]
    rank = {i: () for i in keys}

    def count(order, columns, upto):
        met = Counter()
        for i in order:
            group = (rank[i][:upto], *[one[i][c] for c in columns])
            met[group] += 1
            rank[i] = (*rank[i], met[group])

    count(keys, (1, 2, 3), 0)
    count(keys, (1,), 1)
    count(keys, (2,), 2)
    count(sorted(keys, key=lambda i: rank[i]), (3,), 1)  # a stable sort
    ordered = sorted(keys, key=lambda i: (rank[i], one[i][3]))
    return {(i, rank[i][0]) for i in ordered[:k]}


def test_equals_the_named_order(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for k in (3, 150, 400):
        assert {tuple(r) for r in choose(df, "id", ["cluster_id", "semantic_group", "platform"], k, "score").collect()} == by_sorting(data, k)


def test_one_cell_of_a_million(spark):
    df = spark.range(1_000_000).selectExpr("cast(id as string) id", "'c' cluster_id", "'p' platform").unionByName(spark.createDataFrame([("x", "d", "q")], "id string, cluster_id string, platform string"))
    got = {r.id: r.turn for r in choose(df, "id", ["cluster_id", "platform"], 40).collect()}
    assert len(got) == 40 and got["x"] == 1 and sorted(got.values()) == [1, *range(1, 40)]
    part = first_in_group(df.selectExpr("id _key", "platform", "xxhash64(id) _h"), ["platform"], 39, "r")
    window = part._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in window  # every task sends on its first rows only


def test_empty(spark):
    assert choose(spark.createDataFrame([], SCHEMA), "id", ["cluster_id", "platform"], 5).count() == 0


def test_fair_share(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 7))]
        df = spark.createDataFrame([(n,) for n in sizes], "n long")
        for k in (1, 7, 20, 99):
            r, taken = fair_share(df, k)
            have = lambda r: sum(min(n, r) for n in sizes)  # noqa: E731, B023
            assert have(r) >= min(k, sum(sizes)) and (r == 1 or have(r - 1) < min(k, sum(sizes))) and taken == have(r - 1)
