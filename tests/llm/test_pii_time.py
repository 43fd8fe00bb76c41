"""Every pattern takes time in proportion to the text, whatever is repeated."""

import time

import pytest

from recolta.llm import langid, pii, residue, stuffing

def document_tokens(text):
    return stuffing.tokens([text])


UNITS = ["a", "A", "1", " ", ".", "-", "(", ")", "@", "[", "]", "+", "%", "_", "'", ",", "/", "\n", ".a", "a.", "A-", "A--A", "1 ", "1(", "1.1", "a@a", "a%", "a (dot) ", "a at a dot ", "passport ", "steuerid_", "Anna Aa", "Anna ", "1 A ", "12 Rue A-", "Calle A ", "straße ", "[a](", "{{", "__a.", "[A_", "<<", "é", "́"]


@pytest.mark.parametrize("unit", UNITS)
def test_linear(unit):
    text = "Anna Smith passport no. 12345 " + unit * (100_000 // len(unit)) + " @ x"
    pii.find("Anna 1"), langid.words_of("a"), residue.passages("a")
    for work in (pii.find, langid.segments, langid.words_of, residue.passages, document_tokens):
        start = time.process_time()
        work(text)
        took = time.process_time() - start
        assert took < 1, (work.__name__, unit, took)


def test_nested_dots_of_an_address():
    start = time.process_time()
    assert pii.find("a" + ".a" * 60 + " @ ") == []
    assert time.process_time() - start < 0.1
