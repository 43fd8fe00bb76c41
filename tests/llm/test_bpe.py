import os

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from recolta.llm import bpe

NAMES = ["byte_bpe_50k"]


@pytest.fixture(scope="module")
def peer():
    t = Tokenizer.from_file(os.path.join(bpe.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(peer, texts):
    got = bpe.encoder(bpe.VOCABULARIES, "byte_bpe_50k").encode(texts).to_pylist()
    assert got == [e.ids for e in peer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_fixed(peer):
    check(peer, ["", None, " ", "Hello  world\n\n it's", "aaaaaaaaa aaaa", "<|endoftext|>", "Ünïcödé 漢字 🔥🔥🔥 0123456789", "x" * 30000, " " * 500, "\x00\t\r\n", "a" * 3 + "b" * 4])
    check(peer, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(st.sampled_from("aab the  in\n'se.é1")), st.none()), max_size=6))
def test_random(peer, texts):
    check(peer, texts)


def test_frame(spark, peer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 2)
    rows = [(1, "a b c", 0), (2, None, 0), (3, "", 0), (3, "", 0), (None, "a b c d e f", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in bpe.encode(df, "doc_id", "text").collect())
    assert got == sorted((k or 0, peer.encode(t or "", add_special_tokens=False).ids) for k, t, _ in rows)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
