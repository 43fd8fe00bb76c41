import base64
import math
import os
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from recolta.llm import langid as L

ITEMS = "/root/testdata/sf0.01/items.parquet"
HELD_OUT = {
    "en": ["My neighbour sold his old boat last week.", "Could you please close the door when you leave?"], "de": ["Mein Nachbar hat letzte Woche sein altes Boot verkauft.", "Könntest du bitte die Tür schließen, wenn du gehst?"],
    "fr": ["Mon voisin a vendu son vieux bateau la semaine dernière.", "Pourrais-tu fermer la porte quand tu pars ?"], "es": ["Mi vecino vendió su viejo barco la semana pasada.", "¿Podrías cerrar la puerta cuando te vayas?"],
    "it": ["Il mio vicino ha venduto la sua vecchia barca la settimana scorsa.", "Potresti chiudere la porta quando esci?"], "pt": ["O meu vizinho vendeu o seu velho barco na semana passada.", "Podes fechar a porta quando saíres, por favor?"],
    "nl": ["Mijn buurman heeft vorige week zijn oude boot verkocht.", "Kun je de deur dichtdoen als je weggaat?"],
}


@pytest.fixture(scope="module")
def model():
    return L.fit({})


def test_forward_sums_all_segmentations(model):
    count = L._pieces(model.path)[2]
    pieces = [base64.b64decode(x.split()[0]) for x in open(model.path, "rb")]
    p = np.random.default_rng(1).random((count, 2)) / count
    index = {b: i for i, b in enumerate(pieces)}
    for word in ("garten", "é", "xyz", "a"):
        raw = (" " + word).encode()
        total = np.zeros(2)
        for k in range(len(raw)):
            for cut in combinations(range(1, len(raw)), k):
                parts = [raw[a:b] for a, b in zip((0, *cut), (*cut, len(raw)))]
                if all(x in index for x in parts):
                    total += np.prod([p[index[x]] for x in parts], axis=0)
        got = L.Words([word], model.path).likelihood(p)[0]
        assert np.allclose(got, np.log(total))
        assert math.isclose(L.Words([word], model.path).expected(p[:, [0]], np.array([1.0])).dot([len(x) for x in pieces]), len(raw), rel_tol=1e-9)


def test_built_in_sentences_alone(model):
    """Without any labelled row only some 160 words a language are known."""
    said = [L.cases(L.decide([text], model)[0], None)[0][0] == lang for lang, texts in HELD_OUT.items() for text in texts]
    assert sum(said) >= 10


def test_trained_held_out_and_mixed():
    """Fitted on the first sentence of each language and some built-in ones, on sentences not seen."""
    model = L.fit({lang: [texts[0]] for lang, texts in HELD_OUT.items()})
    for lang, (_, text) in HELD_OUT.items():
        assert L.cases(L.decide([text], model)[0], None)[0][0] == lang, text
    mixed = HELD_OUT["de"][0] + " " + HELD_OUT["fr"][0] + "\n" + HELD_OUT["en"][1]
    assert [c[0] for c in L.cases(L.decide([mixed], model)[0], "de")] == ["de", "fr", "en"]
    assert L.cases(L.decide(["My neighbour sold his old boat Wanderlust last week when the Gemütlichkeit was there."], model)[0], "en") == []
    assert L.decide(["🔥 #abc https://x.example 123 漢字", "", None, " "], model) == [[], [], [], []]


@pytest.mark.skipif(not os.path.exists(ITEMS), reason="no test data")
def test_agrees_with_labels():
    """Labels of the test data are right for the most part; a sixth of the rows is held out."""
    from recolta.llm.visual_form import fold

    rows = pq.read_table(ITEMS, columns=["text_content", "lang"]).to_pylist()
    names = {n: line.split()[0] for line in L.NAMES.strip().splitlines() for n in line.split()}
    rows = [(fold(pa.array([r["text_content"]]))[0].as_py(), names[key]) for r in rows if r["text_content"] and r["lang"] and (key := r["lang"].lower().replace("_", "-").split("-")[0]) in names]
    kept, held = [r for i, r in enumerate(rows) if i % 6], rows[::6]
    model = L.fit({lang: [t for t, k in kept if k == lang] for lang in L.LANGUAGES})
    found = [(f, k) for f, (_, k) in zip(L.decide([t for t, _ in held], model), held) if f and f[0][5] >= L.SENTENCE_WORDS]
    assert np.mean([k in {x[2] for x in f} for f, k in found]) > 0.9


def test_frame(spark):
    rows = [("1", HELD_OUT["de"][0], "EN", "x"), ("2", HELD_OUT["de"][0], "de-AT", "x"), ("2", HELD_OUT["de"][0], "de-AT", "x"), ("3", None, None, "x"), ("4", "", "xx", "x"), ("5", HELD_OUT["es"][1] * 300, "und", "x"), ("6", "404 Not Found", None, "x"), ("7", HELD_OUT["nl"][1], "Japanese", None), (None, HELD_OUT["pt"][0], "Portuguese", "x")]
    df = spark.createDataFrame(rows, "id string, text_content string, lang string, confidence string")
    bad = L.R.fit([])
    model = L.train(df, "text_content", "lang", bad)
    got = {(r.id, r.lang) for r in L.mislabelled(df, "id", "text_content", "lang", model, bad).collect()}
    assert got == {("1", "de"), ("5", "es"), ("7", "nl")}
    langs = {r.id: r.lang for r in L.languages(df, "id", "text_content", model).collect()}
    assert langs["2"] == "de" and langs["3"] is None and langs["4"] is None and langs[None] == "pt"
    assert L.language_segments(df, "id", "text_content", model).filter("id = '1'").count() == 1
    empty = df.limit(0)
    assert L.mislabelled(empty, "id", "text_content", "lang", L.train(empty, "text_content", "lang"), None).count() == 0
    labels = spark.createDataFrame([("en_GB",), ("Deutsch",), ("spa",), ("mul",), ("",), (None,), ("ja",), (" FR ",)], "l string").select(L.label(L.F.col("l"))).collect()
    assert [r[0] for r in labels] == ["en", "de", "es", None, None, None, "other", "fr"]


def test_long_words_are_scored_as_a_whole(model):
    """The likelihood of a long word is that of all its segmentations, also beyond the range of a double."""
    word = "donaudampfschifffahrtsgesellschaftskapitän" * 40
    got = L.Words([word, "kurz"], model.path).likelihood(model.p)
    assert np.isfinite(got).all() and got[0].max() < -1000
    alone = L.Words(["kurz"], model.path).likelihood(model.p)
    assert np.allclose(got[1], alone[0])
    raw, pieces = (" " + word).encode(), {}
    with open(model.path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]): i for i, line in enumerate(f)}
    k, alpha = 1, [0.0] + [-math.inf] * len(raw)
    for end in range(1, len(raw) + 1):
        terms = [alpha[a] + math.log(model.p[i, k]) for a in range(max(0, end - max(map(len, pieces))), end) if (i := pieces.get(raw[a:end])) is not None and alpha[a] > -math.inf]
        alpha[end] = max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)) if terms else -math.inf
    assert math.isclose(got[0, k], alpha[-1], rel_tol=1e-9)


def test_groups_are_bounded():
    words = ["a" * n for n in (1, 5, 3000, 2, 700_000)] + ["b"] * 5000
    parts = L.groups(words)
    assert sorted(i for p in parts for i in p) == list(range(len(words)))
    assert all(len(p) == 1 or len(p) * (max(len(words[i]) for i in p) + 1) <= L.MOST_CELLS for p in parts)
