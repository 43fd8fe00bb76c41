import unicodedata
from itertools import combinations

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from recolta.llm.visual_form import fold, lookalike_pairs

SAME = [("Ｖｉｃ", "Vic"), ("é", "é"), ("a b", "a b"), ("a　b", "a b"), ("a​b﻿", "ab"), ("ԁеѕk", "desk"), ("ﬁn", "fin"), ("q̣̇", "q̣̇"), ("한", "한"), ("𝐀", "A"), ("ё", "ë"), ("a\r\nb", "a\nb"), ("‑", "‐")]
APART = [("a", "A"), ("e", "é"), ("x²", "x2"), ("nº", "no"), ("a  b", "a b"), ("a\nb", "a b"), ("'", "’"), ("…", "..."), ("👨‍👩", "👨👩"), ("l", "I"), ("①", "1"), ("", " ")]


def test_same_and_apart():
    assert all(len(set(fold(pa.array(p)).to_pylist())) == 1 for p in SAME)
    assert all(len(set(fold(pa.array(p)).to_pylist())) == 2 for p in APART)


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aeoAqz \ņ̣́̇éёＡ​①²한𝒳🔥‍")), st.text()), max_size=8))
def test_stable_and_composed(texts):
    once = fold(pa.array(texts, pa.string())).to_pylist()
    assert [x is None for x in once] == [x is None for x in texts]
    assert fold(pa.array(once, pa.string())).to_pylist() == once
    joined = [None if x is None else fold(pa.array([x]))[0].as_py() for x in texts]
    assert joined == once


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aeoqzAȨ̣́̇̈éạ")))
def test_latin_equals_nfc(text):
    assert fold(pa.array([text]))[0].as_py() == unicodedata.normalize("NFC", text)


def test_pairs_equal_brute_force(spark):
    rows = [("1", "ab", "x", 0), ("2", "a​b", None, 0), ("3", "ab", "x", 0), ("4", "аb", "Ｘ", 0), ("5", None, "X", 0), ("6", "", "​", 0), ("6", "", "​", 0), ("7", "​", "", 0), ("8", "z" * 50000, "Y", 0)]
    df = spark.createDataFrame(rows, "id string, text_content string, author string, form int")
    want = set()
    for field, at in (("text_content", 1), ("author", 2)):
        for a, b in combinations(sorted(set(rows), key=lambda r: r[0]), 2):
            if a[at] is not None and b[at] is not None and a[at] != b[at] and len(set(fold(pa.array([a[at], b[at]])).to_pylist())) == 1:
                want.add((field, a[0], b[0]))
    got = [tuple(r) for r in lookalike_pairs(df, "id", ["text_content", "author"]).collect()]
    assert set(got) == want and len(got) == len(want) >= 6
    assert lookalike_pairs(df.limit(0), "id", ["text_content", "author"]).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aA ȩ̣́​еＡﬁ각")), max_size=8), st.integers(0, 8))
def test_any_split_of_a_batch_gives_the_same(texts, at):
    parts = [fold(pa.array(x, pa.string())).to_pylist() for x in (texts[:at], texts[at:])]
    assert parts[0] + parts[1] == fold(pa.array(texts, pa.string())).to_pylist()


def test_marks_at_the_start_of_a_row_stay_in_it():
    assert fold(pa.array(["́", "̣"])).to_pylist() == ["́", "̣"]
    assert fold(pa.array(["​", "́", "̧q"])).to_pylist() == ["", "́", "̧q"]
    assert fold(pa.array(["̣́a"])).to_pylist() == ["̣́a"]
