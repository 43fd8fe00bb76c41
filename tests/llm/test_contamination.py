import random

from recolta.llm import contamination as C


def brute(texts, items, least):
    grams = lambda t: {tuple(w for w, _, _ in C.words(t)[i : i + least]) for i in range(len(C.words(t)) - least + 1)}
    return {(i, k) for i, t in enumerate(texts) if t for k, item in items if item and grams(t) & grams(item)}


def test_random_against_brute_force():
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for _ in range(150):
        items = [(k, make(rng.randrange(12))) for k in range(6)]
        texts = [make(rng.randrange(40)).replace("c c", "c zz c") for _ in range(8)]
        made = C.Automaton(items, 4)
        got = {(i, k) for i, t in enumerate(texts) for k in C._scan(made, t)[0]}
        assert got == brute(texts, items, 4)
        for t in texts:
            numbers = [made.number.get(w, -1) for w, _, _ in C.words(t)]
            joined = [" ".join(w for w, _, _ in C.words(i)) for _, i in items]
            said = [w for w, _, _ in C.words(t)]
            for at, n in enumerate(made.matches(numbers)):
                inside = lambda k: any((" " + " ".join(said[at + 1 - k : at + 1]) + " ") in f" {j} " for j in joined)  # noqa: B023, E731
                assert (n == 0 or inside(n)) and (n == at + 1 or not inside(n + 1))


ITEM = "In Padugo every lantern was sealed firmly until a reviewer with ninety quartz coins compares the barrel."


def test_frame(spark):
    docs = [(1, f"so: {ITEM.upper().replace(' ', '  ')} end", 0), (1, f"so: {ITEM.upper().replace(' ', '  ')} end", 0), (2, " ".join(ITEM.split()[:12]), 0), (3, " ".join(ITEM.split()[:11]), 0), (4, None, 0), (5, "", 0), (6, "w " * 30000 + ITEM.replace(" ", "\n> ") + " w" * 30000, 0), (None, ITEM, 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, ITEM + " And more."), (9, None), (10, ""), (11, "too short")], "item_id long, text string")
    got = {tuple(r) for r in C.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(d, i) for d in (1, 2, 6, None) for i in (7, 8)}
    assert C.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert C.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    clean = {r.doc_id: (r.text, r.removed) for r in C.cleaned(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert clean[3][1] == 0 and clean[4] == (None, 0) and clean[2][0] is None and "Padugo" not in clean[6][0] and clean[6][0].count("w") == 60000


def test_coverage_limit_against_brute_force():
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    for _ in range(100):
        items = [(k, make(rng.randrange(10))) for k in range(5)]
        made = C.Automaton(items, 6, 3)
        for t in (make(rng.randrange(40)) for _ in range(6)):
            short = {k for k, i in items if 3 <= len(i.split()) < 6 and f" {i} " in f" {t} "}
            got, spans = C._scan(made, t)
            assert got == short | {k for _, k in brute([t], items, 6)}
            inside = set()
            for _, i in items:
                n, w = len(i.split()), i.split()
                for size in range(6, n + 1) if n >= 6 else [n] * (n >= 3):
                    for at in range(n - size + 1):
                        said = w[at : at + size]
                        inside |= {p for x in range(len(t.split()) - size + 1) if t.split()[x : x + size] == said for p in range(x, x + size)}
            assert {p for a, b in spans for p in range(a // 2, (b + 1) // 2)} == inside


def test_hidden_forms_are_found(spark):
    words = ITEM.split()
    hidden = ["\u200b".join(ITEM.partition("lantern")[1:2]).join(ITEM.partition("lantern")[::2]), ITEM.replace("sealed", "se\u200baled"), ITEM.replace("every", "\uff45very"), ITEM.replace("coins", "c\u043eins")]
    docs = spark.createDataFrame([(i, f"é {t} end") for i, t in enumerate(hidden)] + [(9, " ".join(words[:5]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "Caf\u00e9 owners count silver spoons")], "item_id long, text string")
    assert {r.doc_id for r in C.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == {0, 1, 2, 3}
    more = spark.createDataFrame([(1, "So cafe\u0301 owners count silver spoons here.")], "doc_id long, text string")
    assert C.leaks(more, "doc_id", "text", items, "item_id", "text").count() == 0
    assert [r.item_id for r in C.leaks(more, "doc_id", "text", items, "item_id", "text", covered=5).collect()] == [8]
    assert C.cleaned(docs, "doc_id", "text", items, "item_id", "text", most_share=1.0).filter("doc_id = 1").first().text == "é . end"


def test_many_parts_and_passes_give_the_same(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(60)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=30)) + " " + " ".join(texts[i].split()[5:25])) for i in range(60)], "doc_id long, text string")
    got = [sorted(tuple(r) for r in C.leaks(docs, "doc_id", "text", items, "item_id", "text", part=p, most=m).collect()) for p, m in ((10**6, 10**6), (300, 10**6), (200, 700))]
    assert got[0] == got[1] == got[2] == [(i, i) for i in range(60)]
    clean = [sorted(tuple(r) for r in C.cleaned(docs, "doc_id", "text", items, "item_id", "text", part=p, most=m).collect()) for p, m in ((10**6, 10**6), (200, 700))]
    assert clean[0] == clean[1]


def test_size_of_a_frozen_automaton():
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60_000)]
    made = C.Automaton([(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(1200)], 12)
    arrays = sum(x.nbytes for x in vars(made).values() if hasattr(x, "nbytes"))
    assert arrays < 80 * 60_000
