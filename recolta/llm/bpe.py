"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

A batch of texts is cut into words by the vocabulary's pattern. Its words not seen before are encoded together: their
bytes stand as symbols in one flat array, and in each round the pair of lowest rank of every word is
found by binary search over the sorted pair keys and merged, until no word has a known pair left.

Defined cases: null, empty and missing texts have an empty list of ids; special tokens' strings are
ordinary text; very long texts and words need no other way; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recolta.llm import arrow_text as A

VOCABULARIES = "/opt/tokenizers"
#: Words that a worker keeps encoded; beyond that it starts anew, with the same results.
CACHED_WORDS = 400_000


# Fixed value: the word pattern of the byte_bpe vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Batched merge rounds over one vocabulary."""

    def __init__(self, folder: str, name: str) -> None:
        import regex

        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # the printable characters that stand for bytes in the file: the printable ones themselves, then the rest from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.byte_id = np.zeros(256, np.int64)
        for b, cp in [*zip(shown, shown), *zip(rest, range(256, 512))]:
            self.byte_id[b] = vocab[chr(cp)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(vocab)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.words = regex.compile(WORDS)
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct words."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done, done_word = [], []
        none = len(self.merged)
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            fits = (self.pair_key[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(fits, self.pair_rank[at], none), none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(symbol)))
            live = np.repeat(lowest < none, length)
            if not live.all():  # words without a known pair are ready
                done.append(symbol[~live]), done_word.append(word[~live])
                symbol, word, rank, lowest, length = symbol[live], word[live], rank[live], lowest[lowest < none], length[lowest < none]
                if not len(symbol):
                    break
            hit = rank == np.repeat(lowest, length)
            # of overlapping hits, as in 'aaa', every second one from the left counts
            index = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - run_start) % 2 == 0
            at = np.flatnonzero(hit)
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        all_symbols, all_words = np.concatenate(done), np.concatenate(done_word)
        order = np.argsort(all_words, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(all_words, minlength=len(words)))])
        return all_symbols[order].astype(np.int32), bounds

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The list array of ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self._clear()
        known, find = self.known, self.words.findall
        fresh: list[str] = []
        index: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            words = find(text)
            counts[i] = len(words)
            for w in words:
                n = known.get(w)
                if n is None:
                    known[w] = n = len(known)
                    fresh.append(w)
                index.append(n)
        if fresh:
            ids, bounds = self.encode_words(fresh)
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
            self.ids = np.concatenate([self.ids, ids])
        at = np.array(index, np.int64)
        length = self.bounds[at + 1] - self.bounds[at]
        values = self.ids[A.ranges(self.bounds[at], length)]
        per_word = np.concatenate([[0], np.cumsum(length)])
        offsets = per_word[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


@lru_cache(maxsize=2)
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(folder, name)
        for batch in batches:
            # the ids of one slice stay within 32-bit offsets however long its texts are
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), made.encode(part.column(1).to_pylist())], [key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def slices(batch: pa.RecordBatch, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `most` bytes of text each, one row at least."""
    _, bounds = A.byte_view(batch.column(1))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
