import os
import random

import pyarrow.parquet as pq
import pytest

from recolta.llm import residue as R
from recolta.llm.visual_form import fold

SUBJECTS = ["the neighbour", "my old bicycle", "our garden", "a small radio", "the train to Lund", "this recipe", "her notebook", "the second lamp"]
VERBS = ["finally works again", "needs a new chain before spring", "made us late for lunch", "was found behind the shelf", "sounds better than I expected", "took the whole weekend"]
TAILS = ["and nobody complained", "because it rained", "so we went home early", "which I did not expect at all", "after the long meeting"]
ABOUT = [
    "I printed lorem ipsum on a shirt and my sister laughed all evening.", "Why do so many shops still break when I turn JavaScript off?", "The docs say to put {{ title }} in the header, so our theme shows the heading now.",
    "The error message said access denied, so I asked the admin and had my folder back in an hour.", "Our designer drew a lovely 404 page with a fox on it.", "haha yes", "need this", "first!", "#abc #def", "1/4", "https://a.example/404",
]
#: None of these is a trusted line.
HELD_OUT = [
    "404 not found (ref 77)", "Sorry, the page you requested is not available.", "Please turn JavaScript on and reload this page.", "Your session expired, please log in.", "%%FIRST_NAME%%", "Dear [USER_NAME], your summary for {{ city }} is ready!",
    "New post by *|BODY|*: <<title>>", "dolore magna aliqua ut enim ad minim veniam", "Bitte aktivieren Sie Skripte und JavaScript in Ihrem Browser.", "Une erreur est survenue, veuillez réessayer.",
]


def corpus():
    rng = random.Random(1)
    return [" ".join(f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(TAILS)}.".capitalize() for _ in range(rng.randrange(1, 4))) for _ in range(900)]


def test_held_out():
    prose = corpus()
    residue = R.TRUSTED.strip().splitlines()
    model = R.fit(prose[:700] + ABOUT * 3 + residue[::9])
    odds = R.residue_odds(prose[700:] + ABOUT, model)
    assert not [t for t, o in zip(prose[700:] + ABOUT, odds) if o >= R.LEAST_ODDS]
    found = [o >= R.LEAST_ODDS for o in R.residue_odds(HELD_OUT + [f"{prose[0]} {HELD_OUT[0]}", f"{HELD_OUT[3]}\n{prose[1]}"], model)]
    assert sum(found) >= len(found) - 1, [t for t, f in zip(HELD_OUT, found) if not f]


def test_frame(spark):
    rows = [("1", "404 Not Found", 0.0), ("1", "404 Not Found", 0.0), ("2", None, 0.0), ("3", "", 0.0), ("4", " \n", 0.0), ("5", "４０４ Not​ Found", 0.0), ("6", corpus()[0] * 900 + " Access denied.", 0.0), (None, "{{x}}", 0.0)]
    rows += [(f"p{i}", t, 1.0) for i, t in enumerate(corpus()[:150])]
    df = spark.createDataFrame(rows, "id string, text_content string, odds double")
    assert {r.id for r in R.residue(df, "id", "text_content").collect()} == {"1", "5", "6", None}
    assert R.residue(df.limit(0), "id", "text_content").count() == 0
    scores = R.scored(df, "id", "text_content", R.train(df, "text_content"))
    assert scores.count() == len(rows) and scores.filter("odds is null").count() == 3


def test_wordings_that_were_never_trusted(monkeypatch):
    """Half of the trusted lines are taken away, each half in turn: three quarters of the texts that hold only such a
    wording are found again, and few texts are found that the whole list doesn't find."""
    path = "/root/testdata/sf0.1/items.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    texts = sorted({t for t in fold(pq.read_table(path, columns=["text_content"]).column(0)).to_pylist() if t})
    random.Random(1).shuffle(texts)
    sample = texts[: R.SAMPLE_TEXTS]
    own = {t: {tuple(p) for p in R.passages(t)} for t in texts}
    flagged = lambda model: {t for t, o in zip(texts, R.residue_odds(texts, model)) if o >= R.LEAST_ODDS}
    every = flagged(R.fit(sample))
    lines = R.TRUSTED.strip().splitlines()
    held = again = 0
    for keep in (0, 1):
        monkeypatch.setattr(R, "TRUSTED", "\n".join(lines[keep::2]))
        kept = {tuple(p) for p in R.trusted()}
        gone = {tuple(p) for line in lines[1 - keep :: 2] for p in R.passages(line)} - kept
        found = flagged(R.fit(sample))
        assert len(found - every) <= 0.01 * len(found)
        only = {t for t in every if own[t] & gone and not own[t] & kept and not any("‹field›" in p for p in own[t])}
        held, again = held + len(only), again + len(only & found)
    assert held > 150 and again >= 0.75 * held


def test_long_texts_enter_the_sample_in_units(spark):
    df = spark.createDataFrame([("a" * (2 * R.SAMPLE_UNIT + 5),), ("b",), (None,), ("",)], "t string")
    assert sorted(len(r.t) for r in df.select(R.sample_units(df.t).alias("t")).collect()) == [0, 1, 5, R.SAMPLE_UNIT, R.SAMPLE_UNIT]
