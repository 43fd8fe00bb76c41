import math
import os
import random
import statistics
from collections import Counter

import pyarrow.parquet as pq
import pytest

from recolta.llm import stuffing as S

NOUNS = ["garden", "letter", "train", "kitchen", "window", "neighbour", "river", "market", "teacher", "bicycle", "story", "winter", "bridge", "engine", "picture", "village"]
VERBS = ["opened", "watched", "carried", "forgot", "painted", "repaired", "described", "followed", "crossed", "finished"]
GOODS = ["garden hose", "office chair", "led lamp", "travel bag"]
TAGS = ["cheap", "buy", "price", "sale", "online", "review", "near me"]


def prose(rng, n):
    say = lambda: f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(['a', 'the', 'every'])} {rng.choice(NOUNS)} {rng.choice(['after the', 'before a', 'near the', 'without any'])} {rng.choice(NOUNS)} and {rng.choice(['we', 'they', 'she'])} {rng.choice(VERBS)} it {rng.choice(['slowly', 'again', 'twice', 'in spring'])}."
    return [say() for _ in range(n)]


def corpus():
    rng = random.Random(2)
    good = [(i, " ".join(prose(rng, rng.randrange(2, 14)))) for i in range(400)]
    good += [(1000, "\n".join(f"{i}. {s}" for i, s in enumerate(prose(rng, 9)))), (1001, "\n".join(prose(rng, 4) * 12)), (1002, " ".join(prose(rng, 8)) + " https://a.example/b #tag #other"), (1003, "Short one."), (1004, "love it")]
    words = lambda k: [f"{rng.choice(TAGS)} {rng.choice(GOODS)}" if rng.random() < 0.5 else f"{rng.choice(GOODS)} {rng.choice(TAGS)}" for _ in range(k)]
    bad = [(2000, ", ".join(words(60))), (2001, " ".join(words(80))), (2002, "\n".join(words(70))), (2003, "\n".join(f"https://x{i}.example/{rng.choice(GOODS).replace(' ', '-')}" for i in range(30))), (2004, " ".join(f"#{w.title().replace(' ', '')}" for w in words(30)))]
    bad += [(2005, prose(rng, 1)[0] + "\n\n" + " | ".join(words(90))), (2006, "\n".join(f"[{w}](http://a.example/{i})" for i, w in enumerate(words(20)))), (2007, "! ".join(w.capitalize() for w in words(60)))]
    return good, bad


def brute_force(rows, information=None):
    """{key: (pairs, mean PMI, excess)} by plain loops; information replaces the PMI of a pair."""
    pairs = {}
    for k, t in rows:
        h, _, line = S.tokens([t])
        pairs[k] = [(int(a), int(b)) for a, b, x, y in zip(h, h[1:], line, line[1:]) if x == y]
    count = Counter(p for v in pairs.values() for p in set(v))
    first, second = Counter(), Counter()
    for (a, b), n in count.items():
        first[a] += n
        second[b] += n
    own = {p: math.log((n - 0.5) / ((first[p[0]] - 1) * (second[p[1]] - 1) / count.total() + 0.5)) for p, n in count.items()}
    value = information(own) if information else own
    out = {}
    for k, v in pairs.items():
        parts = -(-len(v) // S.STRETCH)
        stretches = [Counter(p for i, p in enumerate(v) if i * parts // len(v) == j) for j in range(parts)]
        excess = sum(max(0, n - S.ALLOWED) * max(0, value[p]) for c in stretches for p, n in c.items())
        if v:
            out[k] = (len(v), sum(value[p] for p in v) / len(v), excess / len(v))
    return out


def decided(rows, information=None):
    got = brute_force(rows, information)
    usual = statistics.median_low(pmi for n, pmi, _ in got.values() if n >= S.LEAST_PAIRS)
    return {k for k, (n, pmi, excess) in got.items() if excess + S.INCOHERENCE * (max(0, usual - pmi) if n >= S.LEAST_PAIRS else 0) >= S.STUFFED + S.USUAL * usual}


def test_statistics_equal_brute_force(spark):
    good, bad = corpus()
    rows = [(k, t) for k, t in good[:40] + bad + [(5000, " ".join(prose(random.Random(9), 300)))]]
    want = brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (0, 50, 10**6):
        got = {r.doc_id: (r.pairs, r.pmi, r.excess) for r in S.coherence(df, "doc_id", "text", bound).collect()}
        assert got.keys() == want.keys()
        assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))


def test_lines():
    line = "buy cheap running shoes online best running shoes sale"
    count = lambda t: len(S.tokens([t])[0])
    assert count("\n".join([line] * 3)) == 9 and count("\n".join([line] * 300)) == 2700  # a refrain, and a page of one line
    assert count("One two three. " * 4) == 12 and count("https://a.example/long/path/of/a/page") == 3
    assert len(set(S.tokens(["#one\n#two\n#three"])[2])) == 1  # lines of links run on
    assert [len(x) for x in S.tokens([])] == [0, 0, 0]


def test_information_decides():
    """Without mutual information, or with that of other pairs, a tenth of the pages or more is missed or wrongly found."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist() if r["text"]]
    found = decided(rows)
    assert len(found) >= 40

    def shuffled(own):
        values = list(own.values())
        random.Random(1).shuffle(values)
        return dict(zip(own, values))

    for other in (lambda own: dict.fromkeys(own, 0.0), lambda own: dict.fromkeys(own, 1.0), shuffled):
        instead = decided(rows, other)
        both = len(found & instead)
        assert min(both / len(found), both / max(1, len(instead))) <= 0.9


def test_found(spark):
    good, bad = corpus()
    extra = [(3000, None), (3001, ""), (3002, " \n"), (2000, bad[0][1]), (None, bad[1][1]), (3003, " ".join(prose(random.Random(9), 3000)))]
    df = spark.createDataFrame([(k, t, 0) for k, t in good + bad + extra], "doc_id long, text string, words int")
    got = {r.doc_id for r in S.stuffed(df, "doc_id", "text").collect()}
    assert got == {k for k, _ in bad} | {None}


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert S.stuffed(df, "doc_id", "text").count() == 0 and S.stuffed(df.limit(0), "doc_id", "text").count() == 0


def test_salad_of_many_different_words(spark):
    rng = random.Random(5)
    good, _ = corpus()
    words = sorted({w.strip(".") for _, t in good[:400] for w in t.lower().split()})
    salad = " ".join(rng.sample(words, len(words)))  # no word twice
    df = spark.createDataFrame([(k + 10, t) for k, t in good] + [(9, salad)], "doc_id long, text string")
    rows = {r.doc_id: r for r in S.judged(df, "doc_id", "text").collect()}
    assert rows[9].excess == 0 and rows[9].score >= S.STUFFED
    assert {k for k, r in rows.items() if r.stuffed} == {9}
