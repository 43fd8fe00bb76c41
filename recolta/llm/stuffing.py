"""Keyword-stuffed, link-list and navigation pages (problem 10).

Pairs of neighbouring words are counted over the whole corpus, each once per document. A pair's
pointwise mutual information (PMI) says how much more often its words are neighbours in *other*
documents than by chance. One score in nats decides; it is the sum of

- `excess`, the PMI of repetitions beyond what prose has, per pair: in every stretch of STRETCH pairs,
  occurrences of a collocation (a pair of positive PMI) beyond ALLOWED count with its PMI. The small
  words that prose repeats count little; the collocations of a keyword list, a breadcrumb trail or a
  product table count fully.
- what the document's mean PMI, `pmi`, lacks to the corpus median, times INCOHERENCE: the neighbours in word
  salad and in lists of a keyword with places don't belong together.

A link, tag or handle is a word of its kind, repeated once per LINK_UNIT characters, and lines of
nothing else run on; so a link list is one collocation over and over, and links after prose are few
among its pairs.

Sentences or lines of LONG_LINE words or more count once in a document, so refrains, quotes and repeated
paragraphs are no repetition, unless the line holds a link or most of a document is that line
REFRAINS times. Numbers and punctuation are no words, so numbered lists aren't either.

Python reads the texts once and writes compact arrays (different words as hashes, pairs as positions in
them, counts); all else runs in the JVM. The most frequent words and pairs, as many as fit the broadcast bound, are looked up
by broadcast, which is exact and leaves documents where they are; only rarer ones are shuffled to
their counts, and none of those can be skewed.

Defined cases: null, empty and blank texts and texts without two neighbouring words are no cases; mean
PMI counts from LEAST_PAIRS pairs; a corpus of one document has no evidence against it; repeated documents get equal
results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from recolta.session import materialize

#: A page is stuffed from a score of STUFFED nats and USUAL times the corpus median of mean PMI on: small corpora know less about
#: every pair. What a lack of mean PMI counts, and the fewest pairs for that.
STUFFED, USUAL, INCOHERENCE, LEAST_PAIRS = 0.36, 0.16, 0.5, 25
#: Pairs of a stretch in which repetitions are counted, and the occurrences that are no excess.
STRETCH, ALLOWED = 200, 2
#: Characters of a link for which it counts as one word.
LINK_UNIT = 12
#: Words from which a sentence or line counts once, and how often a line that is most of a document makes it no refrain.
LONG_LINE, REFRAINS = 6, 20
#: Words or pairs that are broadcast at most.
MOST_BROADCAST = 500_000
#: Words whose hashes a worker keeps.
CACHED_WORDS = 500_000

LINK = re.compile(r"\[[^\[\]\n]*\]\([^()\n]*\)|https?://\S+|www\.\S+|(?<!\w)[#@]\w+")
_TOKEN = re.compile(rf"{LINK.pattern}|[^\W\d_]+(?:['’-][^\W\d_]+)*|(?<=[.!?…])\s+|\n")
_STOP, _TAG, _LINK = 0, 1, 2


class _Numbers(dict):
    """Hash of each token: 0 for the end of a sentence, small numbers for links (length * 4 + kind), else a hash."""

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first.isspace():
            made = _STOP
        elif first in "#@":
            made = max(1, len(token) // LINK_UNIT) * 4 + _TAG
        elif not first.isalpha() or token.startswith(("http:", "https:", "www.")):
            made = max(1, len(token) // LINK_UNIT) * 4 + _LINK
        else:
            made = xxhash.xxh64_intdigest(token) | 1 << 63
        self[token] = made
        return made


def tokens(texts: list[str], numbers: _Numbers | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, line) of the words of the texts, after repeated long lines are left out."""
    numbers = _Numbers() if numbers is None else numbers
    lists = [list(map(numbers.__getitem__, _TOKEN.findall(t.lower()))) for t in texts]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    h = np.array([x for own in lists for x in own], np.uint64)
    link = (h >> np.uint64(63) == 0) & (h > 0)
    start = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    line = np.cumsum(start | (h == _STOP))
    real = h > 0
    h, doc, line, link = h[real], doc[real], line[real], link[real]
    if not len(h):
        return h, doc, line
    # a line of links only goes on with the next one
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    sizes = np.diff(np.append(first, len(h)))
    linked = np.add.reduceat(link.astype(np.int64), first)
    only, owner = linked == sizes, doc[first]
    goes_on = np.append(False, only[1:] & only[:-1] & (owner[1:] == owner[:-1]))
    # hash of each line, to find long ones that stood there before
    place = np.arange(len(h)) - np.repeat(first, sizes)
    power = np.multiply.accumulate(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    content = np.add.reduceat(h * power[place], first)
    order = np.lexsort((np.arange(len(first)), content, owner))
    same = np.append(False, (content[order][1:] == content[order][:-1]) & (owner[order][1:] == owner[order][:-1]))
    group = np.cumsum(~same)
    times = np.bincount(group)[group]
    again, often = np.zeros(len(first), bool), np.zeros(len(first), np.int64)
    again[order], often[order] = same, times
    total = np.bincount(owner, sizes, len(lists))
    refrain = (sizes >= LONG_LINE) & (linked == 0) & ~((often >= REFRAINS) & (2 * often * sizes > total[owner]))
    kept = np.repeat(~(again & refrain), sizes)
    number = np.repeat(np.cumsum(~goes_on), sizes)[kept]
    h, doc = h[kept], doc[kept]
    short = h >> np.uint64(63) == 0
    count = np.where(short, h >> np.uint64(2), 1).astype(np.int64)
    return np.repeat(np.where(short, h & np.uint64(3), h), count), np.repeat(doc, count), np.repeat(number, count)


def _arrays(texts: list[str], numbers: _Numbers) -> list[pa.Array]:
    """For each text: its different words, and of its different pairs the positions of both words among them, how
    often each occurs, and how often beyond ALLOWED in a stretch."""
    h, doc, line = tokens(texts, numbers)
    n = len(texts)
    order = np.lexsort((h, doc))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])) if len(h) else np.zeros(0, bool)
    at = order[new]
    rank = np.empty(len(h), np.int64)
    rank[order] = np.cumsum(new) - 1
    word_bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=n))])
    index = (rank - word_bounds[doc]).astype(np.int32)
    near = line[:-1] == line[1:] if len(h) else np.zeros(0, bool)
    near &= doc[:-1] == doc[1:]
    a, b, own = index[:-1][near], index[1:][near], doc[:-1][near]
    pairs = np.bincount(own, minlength=n)
    place = np.arange(len(own)) - (np.cumsum(pairs) - pairs)[own]
    parts = np.maximum(1, -(-pairs // STRETCH))[own]
    stretch = place * parts // np.maximum(1, pairs[own])
    order = np.lexsort((stretch, b, a, own))
    a, b, own, stretch = a[order], b[order], own[order], stretch[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (own[1:] != own[:-1])) if len(a) else np.zeros(0, bool)
    part = fresh | np.append(True, stretch[1:] != stretch[:-1]) if len(a) else fresh
    first, cut = np.flatnonzero(fresh), np.flatnonzero(part)
    over = np.maximum(0, np.diff(np.append(cut, len(a))) - ALLOWED)
    pair_of = (np.cumsum(fresh) - 1)[cut]
    beyond = np.bincount(pair_of, over, len(first)).astype(np.int32)
    times = np.diff(np.append(first, len(a))).astype(np.int32)
    pair_bounds = np.concatenate([[0], np.cumsum(np.bincount(own[first], minlength=n))]).astype(np.int32)
    lists = lambda bounds, x: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x))
    return [lists(word_bounds, h[at].view(np.int64)), *[lists(pair_bounds, x) for x in (a[first], b[first], times, beyond)]]


def document_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, word, first, second, times, beyond): each document with its different words as hashes and its
    different pairs as positions in them. h tells apart documents of the same key."""
    kind = dict(df.dtypes)[key]
    names = [key, "h", "word", "first", "second", "times", "beyond"]
    numbers = _Numbers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(numbers) > CACHED_WORDS:
                numbers.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *_arrays(batch.column(1).to_pylist(), numbers)], names)

    t = F.col(text).cast("string")
    source = df.filter(F.trim(t) != "").select(key, t.alias("_t"), F.xxhash64(t).alias("h"))
    return source.mapInArrow(run, f"{key} {kind}, h long, word array<long>, first array<int>, second array<int>, times array<int>, beyond array<int>")


def _looked_up(facts: DataFrame, on: str, counts: DataFrame, n: str, most: int) -> tuple[DataFrame, DataFrame]:
    """facts JOIN counts ON `on`, in two parts: the most frequent keys (at most `most`, by their count `n`) by
    broadcast, the others by a shuffle join in which no key is heavy."""
    sizes = counts.groupBy(F.floor(F.log2(n)).cast("int").alias("k")).count().orderBy(F.desc("k")).collect()  # at most 63 rows
    least, taken = 62, 0
    for r in sizes:
        if taken + r["count"] > most:
            break
        least, taken = r.k, taken + r["count"]
    often = F.col(n) >= F.lit(2**least)
    marked = facts.join(F.broadcast(counts.filter(often).withColumn("_often", F.lit(True))), on, "left")
    found = marked.filter("_often").drop("_often")
    rest = marked.filter("_often IS NULL").select(*facts.columns).join(counts.filter(~often), on)
    return found, rest.select(*found.columns)


def pair_information(docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(pair, n, pmi): for each pair the documents with it, and its mutual information in the documents other than one
    that holds it, smoothed by half an occurrence. A word's rate is that of the pairs that it begins or ends."""
    pairs = materialize(_pairs(docs).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.min("b").alias("b")), "pair-counts")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    for side in ("a", "b"):
        words = materialize(pairs.groupBy(side).agg(F.sum("n").alias(f"c{side}")), f"word-counts-{side}")
        one, two = _looked_up(pairs, side, words, f"c{side}", most_broadcast)
        pairs = materialize(one.unionByName(two), f"pairs-{side}")
    expected = (F.col("ca") - 1) * ((F.col("cb") - 1) / F.lit(float(total)))
    return pairs.select("pair", "n", F.log((F.col("n") - 0.5) / (expected + 0.5)).alias("pmi"))


def _pairs(docs: DataFrame, *own: str) -> DataFrame:
    """(own columns, pair, a, b, times, beyond): one row per different pair of each document."""
    each = docs.select(*own, "word", F.explode(F.arrays_zip("first", "second", "times", "beyond")).alias("x"))
    a, b = F.get("word", F.col("x.first")), F.get("word", F.col("x.second"))
    return each.select(*own, F.xxhash64(a, b).alias("pair"), a.alias("a"), b.alias("b"), "x.times", "x.beyond")


def coherence(df: DataFrame, key: str, text: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(key, h, pairs, pmi, excess) of every document with two neighbouring words."""
    docs = materialize(document_pairs(df, key, text), "document-pairs")
    known = pair_information(docs, most_broadcast)
    each = _pairs(docs, key, "h").select(key, "h", "pair", "times", "beyond")
    sums = [F.sum(F.col("pmi") * F.col("times")).alias("s"), F.sum("times").alias("t"), F.sum(F.greatest(F.lit(0.0), "pmi") * F.col("beyond")).alias("e")]
    parts = [x.groupBy(key, "h").agg(*sums) for x in _looked_up(each, "pair", known, "n", most_broadcast)]
    summed = parts[0].unionByName(parts[1]).groupBy(key, "h").agg(*[F.sum(c).alias(c) for c in "ste"])
    return summed.select(key, "h", F.col("t").alias("pairs"), (F.col("s") / F.col("t")).alias("pmi"), (F.col("e") / F.col("t")).alias("excess"))


def judged(df: DataFrame, key: str, text: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """coherence() with `score` and `stuffed`."""
    docs = materialize(coherence(df, key, text, most_broadcast), "coherence")
    enough = F.col("pairs") >= LEAST_PAIRS
    usual = docs.agg(F.percentile_approx(F.when(enough, F.col("pmi")), F.lit(0.5), F.lit(1000)).alias("m")).first().m
    lack = F.when(enough, F.greatest(F.lit(0.0), F.lit(usual).cast("double") - F.col("pmi"))).otherwise(0.0)
    return docs.withColumn("score", F.col("excess") + INCOHERENCE * lack).withColumn("stuffed", F.col("score") >= STUFFED + USUAL * (usual or 0.0))


def stuffed(df: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct keys of stuffed documents."""
    return judged(df, key, text).filter("stuffed").select(key).distinct()
