"""The languages are fitted on every labelled row, by the driver or by the executors."""

import random

import numpy as np
import pytest

from recolta.llm import langid as L

BODY = {"en": "My neighbour sold the old boat last week and then there was nothing more to say about {}.", "de": "Mein Nachbar hat letzte Woche das alte Boot verkauft und danach war nichts mehr über {} zu sagen."}


def texts(count: int) -> dict[str, list[str]]:
    rng = random.Random(3)
    made = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    return {lang: [body.format(made()) for _ in range(count)] for lang, body in BODY.items()}


@pytest.mark.parametrize("driver_words", [L.DRIVER_WORDS, 0])
def test_every_labelled_text_is_fitted_on(spark, monkeypatch, driver_words):
    monkeypatch.setattr(L, "DRIVER_WORDS", driver_words)
    own = texts(2000)
    df = spark.createDataFrame([(t, lang) for lang, ts in own.items() for t in ts], "t string, lang string")
    assert np.allclose(L.train(df, "t", "lang").p, L.fit(own).p, rtol=1e-9, atol=0)


def test_wrong_labels_weigh_the_same_at_any_size():
    counts = np.array([[900.0, 30.0], [5.0, 300.0], [50.0, 0.0]])
    few, many = L._spread(counts, counts.sum(0)), L._spread(1000 * counts, 1000 * counts.sum(0))
    assert np.allclose(few / few.sum(1, keepdims=True), many / many.sum(1, keepdims=True))
