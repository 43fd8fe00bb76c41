"""The residue model is fitted on every passage of the table, by the driver or by the executors."""

import os
import random

import pyarrow.parquet as pq
import pytest

from recolta.llm import residue as R
from recolta.llm.visual_form import fold

ITEMS = "/root/testdata/sf0.01/items.parquet"


@pytest.mark.skipif(not os.path.exists(ITEMS), reason="no test data")
@pytest.mark.parametrize("size", [R.SAMPLE_TEXTS, 500])
def test_executors_fit_as_the_driver(spark, monkeypatch, size):
    monkeypatch.setattr(R, "SAMPLE_TEXTS", size)
    items = spark.read.parquet(ITEMS)
    alone = R.train(items, "text_content")
    monkeypatch.setattr(R, "DRIVER_PASSAGES", 0)
    spread = R.train(items, "text_content")
    assert abs(alone.prior - spread.prior) < 0.02
    texts = [t for t in fold(pq.read_table(ITEMS, columns=["text_content"]).column(0)).to_pylist() if t]
    found = [[o >= R.LEAST_ODDS for o in R.residue_odds(texts, m)] for m in (alone, spread)]
    assert found[0] == found[1] and any(found[0])


def test_every_text_enters_the_fit(spark):
    rng = random.Random(5)
    made = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    texts = [f"We saw {made()} near the old {made()}" for _ in range(R.SAMPLE_TEXTS + 3000)]
    model, whole = R.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t"), R.fit(texts)
    assert model.weight.keys() == whole.weight.keys() and abs(model.prior - whole.prior) < 1e-9


def test_marked_texts_score_alike():
    model = R.fit([])
    texts = ["404 Not Found", "Our cat Page not found Sleeps. {{ name }} 12", "", "Hello There [x] World\nAccess denied."]
    assert R.marked_odds([R.marked(t) for t in texts], model) == R.residue_odds(texts, model)
    assert [R._unmarked(x) for x in R.marked(texts[1]).split("\n")] == R.cut_passages(texts[1])
