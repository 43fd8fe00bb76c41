"""Missing, wrong and mixed language labels (problem 7).

Each language has probabilities of the pieces of a fixed public vocabulary. A word's likelihood is
the sum over all its segmentations into pieces of any length, by a forward algorithm that runs over many
words at once; pieces are found by rolling hashes and binary search. The probabilities are fitted by
expectation-maximization, on built-in sentences and on every labelled row: first all of them, then
their stretches that the first model finds to be in the language of the label, since labels are partly
wrong. What is fitted on is counts of words, which Spark adds up; a vocabulary that is large is fitted in
parts by the executors, which send their expected counts.

A text's segments are its sentences and lines. Their languages are decided together, by a Viterbi
pass in which a change of language has a cost, so that single foreign words and short segments
don't count. A word's log-posterior has a floor; names and misspellings can't outvote a sentence.

Defined cases: null, empty and blank texts, and texts without words in Latin letters have no
language; links, handles, hashtags and addresses are no words; ties go to the first language in
LANGUAGES; an empty table is scored by the built-in sentences; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from recolta.llm import residue as R
from recolta.llm.bpe import VOCABULARIES
from recolta.llm.plain_text import SENTENCES
from recolta.llm.visual_form import fold
from recolta.session import materialize

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl")
#: Words of all languages up to which the driver fits by itself; with more the executors do, with equal results.
DRIVER_WORDS = 20_000
#: Cells of a matrix of words that are scored at once, words times bytes; and how many bytes apart the forward sums are rescaled.
MOST_CELLS, RESCALE = 400_000, 64
#: Lowest log-posterior of a word, cost of a change of language, and words kept by a worker.
FLOOR, CHANGE, CACHED_WORDS = -5.0, 7.0, 300_000
#: Pieces of all languages' rates that are added to each language's own counts.
SHRINK = 300.0
#: Log-odds that contradict a label, and words of a segment from which it counts as a sentence.
CONTRADICTION, SENTENCE_WORDS = 5.0, 3

# Names and codes of the languages.
NAMES = """
en eng english englisch anglais inglés ingles inglese inglês engels
de deu ger german deutsch allemand alemán aleman tedesco alemão duits
fr fra fre french französisch français francais francés francese francês frans
es spa esp spanish spanisch espagnol español espanol castellano spagnolo espanhol spaans
it ita italian italienisch italien italiano italiaans
pt por portuguese portugiesisch portugais portugués português portugues portoghese portugees
nl nld dut dutch niederländisch néerlandais neerlandais neerlandés nederlands olandese holandês flemish vlaams
"""
# Names that stand for no language.
_NO_LANGUAGE = ("", "und", "mul", "mis", "zxx", "xx", "unknown", "none", "null", "undefined", "n/a", "na", "other", "?")
_NOISY = re.compile(r"[\d_@#]|https?://|www\.")  # without any of these there is no noise
_NOISE = re.compile(r"https?://\S+|www\.\S+|(?<![\w.+-])[\w.+-]++@[\w.-]+|[#@]\w+|\b\w*[\d_]\w*\b")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"(?<![.!?…])[.!?…]++[\"'”’»)\]]*+(?=\s)\s*+|(?<!\s)(?:(?=\s*\n)\s++|\s++[/|]\s++)")
_LATIN = re.compile(r"[a-zà-öø-ɏß]+")
_BASE = np.uint64(1_099_511_628_211)


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(sorted hashes, number of each, count, greatest length) of all pieces of the vocabulary."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f]
    hashes, longest = np.empty(len(pieces), np.uint64), max(map(len, pieces))
    for n in range(1, longest + 1):
        own = [i for i, p in enumerate(pieces) if len(p) == n]
        if own:
            b = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(own), np.uint64)
            for j in range(n):
                h = h * _BASE + b[:, j] + np.uint64(1)
            hashes[own] = h * np.uint64(31) + np.uint64(n)
    order = np.argsort(hashes)
    return hashes[order], order, len(pieces), longest


def groups(words: list[str]) -> list[list[int]]:
    """The words' positions in groups of similar length, each a matrix of at most MOST_CELLS cells or one word."""
    sizes = [len(w.encode()) + 1 for w in words]
    out: list[list[int]] = []
    for i in sorted(range(len(words)), key=lambda i: -sizes[i]):
        if not out or (len(out[-1]) + 1) * sizes[out[-1][0]] > MOST_CELLS:
            out.append([])
        out[-1].append(i)
    return out


class Words:
    """Words as a byte matrix, with the pieces that end at each place."""

    def __init__(self, words: list[str], path: str) -> None:
        hashes, number, self.count, self.longest = _pieces(path)
        raw = [(" " + w).encode() for w in words]
        self.size = np.array([len(r) for r in raw], np.int64)
        width = int(self.size.max(initial=0))
        cells = np.zeros((len(raw), width), np.uint64)
        mask = np.arange(width) < self.size[:, None]
        cells[mask] = np.frombuffer(b"".join(raw), np.uint8)
        prefix = np.zeros((len(raw), width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * _BASE + cells[:, j] + np.uint64(1)
        self.width = width
        power = 1
        #: By end: (length, rows, pieces).
        self.ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
        for n in range(1, min(self.longest, width) + 1):
            power = power * int(_BASE) % 2**64
            h = (prefix[:, n:] - prefix[:, :-n] * np.uint64(power)) * np.uint64(31) + np.uint64(n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = (hashes[at] == h) & (np.arange(n, width + 1) <= self.size[:, None])
            rows, ends = np.nonzero(hit)
            by = np.argsort(ends, kind="stable")
            rows, ends, ids = rows[by], ends[by], number[at[rows[by], ends[by]]]
            for e in np.unique(ends):
                own = slice(*np.searchsorted(ends, [e, e + 1]))
                self.ends[int(e) + n].append((n, rows[own], ids[own]))

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, scale): total probability of all segmentations up to each place, by word, place and language, and the
        logarithm that was taken out of a word's last place, so that long words don't underflow."""
        alpha = np.zeros((len(self.size), self.width + 1, p.shape[1]))
        scale = np.zeros((len(self.size), 1))
        alpha[:, 0] = 1
        for end in range(1, self.width + 1):
            for n, rows, ids in self.ends[end]:
                alpha[rows, end] += alpha[rows, end - n] * p[ids]
            if end % RESCALE == 0:
                going = np.flatnonzero(self.size > end)  # all that later places look back at is rescaled together
                low = max(0, end + 1 - self.longest)
                top = np.maximum(alpha[going, low : end + 1].max((1, 2)), 1e-300)
                alpha[going, low : end + 1] /= top[:, None, None]
                scale[going, 0] += np.log(top)
        return alpha, scale

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        """(words, languages) log-likelihoods."""
        alpha, scale = self.forward(p)
        return np.log(np.maximum(alpha[np.arange(len(self.size)), self.size], 1e-300)) + scale

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of each piece in one language; counts by word. p has one column. Words have at most
        RESCALE bytes."""
        alpha = self.forward(p)[0][:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.size)), self.size] = 1
        for end in range(self.width, 0, -1):
            for n, rows, ids in self.ends[end]:
                beta[rows, end - n] += beta[rows, end] * p[ids, 0]
        scale = counts / np.maximum(alpha[np.arange(len(self.size)), self.size], 1e-300)
        out = np.zeros(len(p))
        for end in range(1, self.width + 1):
            for n, rows, ids in self.ends[end]:
                np.add.at(out, ids, scale[rows] * alpha[rows, end - n] * p[ids, 0] * beta[rows, end])
        return out


def words_of(text: str) -> list[str]:
    """The words of a text that can tell a language, in lower case."""
    plain = _NOISE.sub(" ", text) if _NOISY.search(text) else text
    return [w for w in _WORD.findall(plain.lower()) if _LATIN.fullmatch(w)]


def segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text."""
    out, last = [], 0
    for m in _END.finditer(text):
        out.append((last, m.end()))
        last = m.end()
    if last < len(text):
        out.append((last, len(text)))
    return out


def _spread(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """What the (words, languages) counts of words weigh, given those of all words: a word weighs as the logarithm of its count, since
    a wording that is stored often tells no more; its languages share that by their rates, so that wrong labels, whose number
    grows with the table, weigh the same in a table of any size."""
    rates = counts / totals
    return rates / rates.sum(1, keepdims=True) * (1 + np.log(counts.sum(1, keepdims=True)))


@dataclass
class Model:
    """Piece probabilities (pieces, languages), with the words scored so far."""

    p: np.ndarray
    path: str
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LANGUAGES))))

    def __getstate__(self) -> dict:
        return {"p": self.p.astype(np.float32), "path": self.path, "known": {}, "table": np.zeros((0, len(LANGUAGES)))}

    def places(self, words: list[str]) -> np.ndarray:
        """The words' rows in the table of floored log-posteriors."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        fresh = sorted({w for w in words if w not in known})
        if fresh:
            made = np.empty((len(fresh), len(LANGUAGES)))
            for own in groups(fresh):
                ll = Words([fresh[i] for i in own], self.path).likelihood(np.asarray(self.p, float))
                ll -= ll.max(1, keepdims=True)
                made[own] = np.maximum(ll - np.log(np.exp(ll).sum(1, keepdims=True)), FLOOR)
            for w in fresh:
                known[w] = len(known)
            self.table = np.concatenate([self.table, made])
        return np.array([known[w] for w in words], np.int64)

    def sums(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The sums of the table's rows at[bounds[i]:bounds[i+1]]."""
        sums = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(self.table[at], axis=0)]) if len(at) else np.zeros((1, len(LANGUAGES)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def posteriors(self, lists: list[list[str]]) -> np.ndarray:
        """For each list of words the sum of their floored log-posteriors."""
        bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in lists])]).astype(np.int64)
        return self.sums(self.places([w for ws in lists for w in ws]), bounds)


def _parts(words: list[str], counts: np.ndarray, path: str) -> list[tuple[Words, np.ndarray]]:
    return [(Words([words[i] for i in own], path), counts[own]) for own in groups(words)]


def _expected(parts: list[tuple[Words, np.ndarray]], p: np.ndarray, pieces: int) -> np.ndarray:
    """(pieces, columns of p) expected counts; with one column the words' counts of all languages are added."""
    out = np.zeros((pieces, p.shape[1]))
    for table, counts in parts:
        for k in range(p.shape[1]):
            own = counts.sum(1) if p.shape[1] == 1 else counts[:, k]
            if own.any():
                out[:, k] += table.expected(p[:, [k]], own)
    return out


def _maximize(expected, pieces: int, rounds: int) -> np.ndarray:
    """Piece probabilities by EM; expected gives the counts that probabilities lead to."""
    shared = np.full((pieces, 1), 1 / pieces)
    for _ in range(rounds):
        got = expected(shared)
        shared = (got + 0.01) / (got.sum() + 0.01 * pieces)
    p = np.repeat(shared, len(LANGUAGES), axis=1)
    for _ in range(rounds):
        got = expected(p)
        # a language's rates shrink to those of all languages together
        p = (got + SHRINK * shared) / (got.sum(0) + SHRINK)
    return p


def _path(folder: str) -> str:
    return os.path.join(folder, "byte_bpe_multi_50k.tiktoken")


def fit(texts: dict[str, list[str]], folder: str = VOCABULARIES, rounds: int = 3) -> Model:
    """Piece probabilities of each language from its texts and its built-in sentences."""
    path = _path(folder)
    by = {}
    for lang in LANGUAGES:
        by[lang] = Counter(w for t in {*texts.get(lang, []), SENTENCES[lang]} for w in words_of(t))
    vocabulary = sorted({w for c in by.values() for w in c if len(w.encode()) < RESCALE})  # longer ones tell nothing here
    counts = np.array([[by[lang][w] for lang in LANGUAGES] for w in vocabulary], float)
    parts = _parts(vocabulary, _spread(counts, counts.sum(0)), path)
    pieces = _pieces(path)[2]
    return Model(_maximize(lambda p: _expected(parts, p, pieces), pieces, rounds), path)


def _fit_counts(counts: DataFrame, folder: str, rounds: int) -> Model:
    """The model of a table (l, w, n) of words by language, its n still to be added up."""
    spark, path = counts.sparkSession, _path(folder)
    pieces = _pieces(path)[2]
    built_in = [(lang, w, n) for lang in LANGUAGES for w, n in Counter(words_of(SENTENCES[lang])).items()]
    every = counts.unionByName(spark.createDataFrame(built_in, "l string, w string, n long")).filter(F.octet_length("w") < RESCALE)
    table = materialize(every.groupBy("w").agg(*[F.sum(F.when(F.col("l") == x, F.col("n")).otherwise(0)).alias(x) for x in LANGUAGES]), "langid-words")
    size, *totals = table.agg(F.count(F.lit(1)), *[F.sum(x) for x in LANGUAGES]).first()
    totals = np.array(totals, float)
    if size <= DRIVER_WORDS:
        rows = sorted(table.collect())
        parts = _parts([r[0] for r in rows], _spread(np.array([r[1:] for r in rows], float), totals), path)
        return Model(_maximize(lambda p: _expected(parts, p, pieces), pieces, rounds), path)

    def expected(p: np.ndarray) -> np.ndarray:
        shared, names = spark.sparkContext.broadcast(p), [f"c{k}" for k in range(p.shape[1])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(shared.value.shape)
            for batch in batches:
                words, n = batch.column(0).to_pylist(), np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                sizes = _spread(n, totals)
                for own in groups(words):  # one part in memory at a time
                    got += _expected(_parts([words[i] for i in own], sizes[own], path), shared.value, len(got))
            at = np.flatnonzero(got.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(c) for c in got[at].T]], ["piece", *names])

        sums = table.mapInArrow(run, ", ".join(["piece int", *[f"{c} double" for c in names]])).groupBy("piece").agg(*[F.sum(c).alias(c) for c in names])
        out = np.zeros(p.shape)
        for r in sums.collect():
            out[r.piece] = r[1:]
        shared.destroy()
        return out

    return Model(_maximize(expected, pieces, rounds), path)


def label(column: Column) -> Column:
    """The language that a label names, whatever its notation or region: one of LANGUAGES, 'other', or null for none."""
    plain = F.lower(F.trim(column))
    first = F.regexp_extract(plain, r"^([^\W\d_]+)", 1)
    out = F.when(column.isNull() | plain.isin(*_NO_LANGUAGE) | (first == ""), F.lit(None))
    for line in NAMES.strip().splitlines():
        names = line.split()
        out = out.when(first.isin(*names), F.lit(names[0]))
    return out.otherwise("other")


def worded(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, _l, _words, _marked): the language that the label names, the words of each text, its segments divided by line ends,
    and its passages as residue.marked() cuts them. Texts without any are left out."""

    def work(batch: pa.RecordBatch):
        texts = [t or "" for t in fold(batch.column(1)).to_pylist()]
        words = ["\n".join([" ".join(words_of(t[a:b])) for a, b in segments(t)]) for t in texts]
        cut = [R.marked(t) for t in texts]
        keep = [i for i, w in enumerate(words) if cut[i] or w and not w.isspace()]
        return keep, [batch.column(2).take(pa.array(keep, pa.int64())), *[pa.array([x[i] for i in keep], pa.string()) for x in (words, cut)]]

    kind = dict(df.dtypes)[key]
    columns = [F.col(key), F.col(text).cast("string").alias("_t"), label(F.col(lang).cast("string")).alias("_l")]
    return _run(df, columns, [key, "_l", "_words", "_marked"], f"{key} {kind}, _l string, _words string, _marked string", work)


def without_residue(table: DataFrame, key: str, ignore: R.Model | None) -> DataFrame:
    """(key, _l, _words) of the rows of `worded` that have words and hold no residue by the model `ignore`."""
    shared = table.sparkSession.sparkContext.broadcast(ignore)

    def work(batch: pa.RecordBatch):
        keep = [i for i, w in enumerate(batch.column(2).to_pylist()) if not w.isspace() and w]
        if shared.value is not None and keep:
            odds = R.marked_odds(batch.column(3).take(pa.array(keep, pa.int64())).to_pylist(), shared.value)
            keep = [i for i, o in zip(keep, odds) if o < R.LEAST_ODDS]
        at = pa.array(keep, pa.int64())
        return keep, [batch.column(1).take(at), batch.column(2).take(at)]

    kind = dict(table.dtypes)[key]
    return _run(table, [F.col(key), F.col("_l"), F.col("_words"), F.col("_marked")], [key, "_l", "_words"], f"{key} {kind}, _l string, _words string", work)


def _split(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(bounds of the segments of each row, all words, bounds of the words of each segment) of a column of words of `worded`."""
    lines = pc.split_pattern(column, "\n")
    words = pc.split_pattern(lines.flatten(), " ")
    flat, ends = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(flat, "")  # a segment without words is one empty string
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return lines.offsets.to_numpy().astype(np.int64), flat.filter(full), kept[ends]


def _places(words: pa.Array, model: Model) -> np.ndarray:
    coded = words.dictionary_encode()
    return model.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]


def _counted(rows: DataFrame, first: Model | None = None) -> DataFrame:
    """(l, w, n) of rows (_l, _words), n still to be added up; of the segments in the language l only, if there is a first model."""
    shared = rows.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words, ends = _split(batch.column(1))
            names = np.array([LANGUAGES.index(x) for x in batch.column(0).to_pylist()], np.int64)
            own = np.repeat(np.repeat(names, np.diff(lines)), np.diff(ends))
            if shared.value is not None:
                paths = _paths(shared.value.sums(_places(words, shared.value), ends), np.diff(ends), lines)
                agreed = np.repeat(paths, np.diff(ends)) == own
                words, own = words.filter(pa.array(agreed)), own[agreed]
            coded = words.dictionary_encode()
            pairs, n = np.unique(own * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
            lang, word = np.divmod(pairs, max(1, len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays([pa.array([LANGUAGES[k] for k in lang], pa.string()), coded.dictionary.take(pa.array(word)), pa.array(n.astype(np.int64))], ["l", "w", "n"])

    return rows.select("_l", "_words").mapInArrow(run, "l string, w string, n long")


def train_worded(table: DataFrame, folder: str = VOCABULARIES) -> Model:
    """Fit on all labelled rows of `without_residue`, each wording of a language once, then on what of them the first model agrees with."""
    rows = materialize(table.filter(F.col("_l").isin(*LANGUAGES)).select("_l", "_words").distinct(), "langid-labelled")
    return _fit_counts(_counted(rows, _fit_counts(_counted(rows), folder, 2)), folder, 3)


def train(df: DataFrame, text: str, lang: str, ignore: R.Model | None = None, folder: str = VOCABULARIES) -> Model:
    """Fit on the labelled texts of df, without residue by the model `ignore`."""
    words = worded(df.select(F.lit(0).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")), "k", "t", "l")
    return train_worded(without_residue(words, "k", ignore), folder)


def _paths(scores: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language of each segment; text i has the segments bounds[i]:bounds[i+1]."""
    best = scores.argmax(1) if len(scores) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(counts > 0)
    low, high = np.full(len(bounds) - 1, len(LANGUAGES)), np.full(len(bounds) - 1, -1)
    np.minimum.at(low, of[at], best[at]), np.maximum.at(high, of[at], best[at])
    path = low[of]
    for i in np.flatnonzero(low < high):
        path[bounds[i] : bounds[i + 1]] = _viterbi(scores[bounds[i] : bounds[i + 1]])
    return path


Found = list[tuple[int, int, str, float, float, int]]


def decide(texts: list[str | None], model: Model) -> list[Found]:
    """For each text its stretches of one language: (start, end, language, confidence, log-odds, most words of a segment)."""
    spans = [segments(t) if t else [] for t in texts]
    lists = [words_of(t[a:b]) for t, own in zip(texts, spans) for a, b in own]
    bounds = np.concatenate([[0], np.cumsum([len(own) for own in spans])]).astype(np.int64)
    return _stretches([s for own in spans for s in own], bounds, np.array([len(ws) for ws in lists], np.int64), model.posteriors(lists))


def _stretches(spans: list[tuple[int, int]], bounds: np.ndarray, counts: np.ndarray, scores: np.ndarray) -> list[Found]:
    path, out = _paths(scores, counts, bounds).tolist(), []
    sizes, bounds = counts.tolist(), bounds.tolist()
    for i, n in zip(bounds[:-1], bounds[1:]):
        found: Found = []
        if any(sizes[i:n]):
            while i < n:
                j = i
                while j < n and path[j] == path[i]:
                    j += 1
                total = scores[i:j].sum(0)
                odds = float(total[path[i]] - np.delete(total, path[i]).max())
                share = np.exp(np.clip(total - total[path[i]], -50, 50))
                if any(sizes[i:j]):
                    found.append((spans[i][0], spans[j - 1][1], LANGUAGES[path[i]], float(1 / share.sum()), odds, max(sizes[i:j])))
                i = j
        out.append(found)
    return out


def _viterbi(s: np.ndarray) -> list[int]:
    score, back = s[0].copy(), []
    for row in s[1:]:
        stay, jump = score, score.max() - CHANGE
        back.append(np.where(stay >= jump, np.arange(len(score)), int(score.argmax())))
        score = np.maximum(stay, jump) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def cases(found: list[tuple[int, int, str, float, float, int]], named: str | None) -> list[tuple[str, float]]:
    """(language, confidence) of a text whose label is null, wrong or can't be right since it is mixed."""
    if not found:
        return []
    whole = [f for f in found if f[5] >= SENTENCE_WORDS]
    langs = dict.fromkeys(f[2] for f in whole)
    if len(langs) > 1:
        return [(lang, max(f[3] for f in whole if f[2] == lang)) for lang in langs]
    main = max(found, key=lambda f: (f[5], f[4]))
    if named == main[2]:
        return []
    if named is None or main[4] >= CONTRADICTION and main[5] >= SENTENCE_WORDS:
        return [(main[2], main[3])]
    return []


def _run(df: DataFrame, columns: list[Column], names: list[str], schema: str, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = work(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *values], names)

    return df.select(*columns).mapInArrow(run, schema)


def language_segments(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, segment, start, end, lang, confidence): the stretches of one language of every text, numbered
    from 0; positions are those of the text's consistent visual form."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        rows = [(i, n, *f[:4]) for i, found in enumerate(decide(fold(batch.column(1)).to_pylist(), shared.value)) for n, f in enumerate(found)]
        at = lambda j, kind: pa.array([r[j] for r in rows], kind)
        return [r[0] for r in rows], [at(1, pa.int32()), at(2, pa.int32()), at(3, pa.int32()), at(4, pa.string()), at(5, pa.float64())]

    kind = dict(df.dtypes)[key]
    names = [key, "segment", "start", "end", "lang", "confidence"]
    return _run(df, [F.col(key), F.col(text).cast("string").alias("_t")], names, f"{key} {kind}, segment int, start int, `end` int, lang string, confidence double", work)


def languages(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, lang, confidence) of every row, the language of most of its text; null without words."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        lang, sure = [], []
        for found in decide(fold(batch.column(1)).to_pylist(), shared.value):
            size: Counter[str] = Counter()
            for a, b, name, *_ in found:
                size[name] += b - a
            main = max(size, key=size.get, default=None)
            lang.append(main), sure.append(max((f[3] for f in found if f[2] == main), default=None))
        return list(range(len(batch))), [pa.array(lang, pa.string()), pa.array(sure, pa.float64())]

    kind = dict(df.dtypes)[key]
    return _run(df, [F.col(key), F.col(text).cast("string").alias("_t")], [key, "lang", "confidence"], f"{key} {kind}, lang string, confidence double", work)


def mislabelled(df: DataFrame, key: str, text: str, lang: str, model: Model, ignore: R.Model | None) -> DataFrame:
    """(key, lang, confidence): texts whose label is missing or wrong, and all mixed texts with a row for each
    language. Texts that hold residue by the model `ignore` are left out."""
    return mislabelled_worded(without_residue(worded(df, key, text, lang), key, ignore), key, model)


def mislabelled_worded(table: DataFrame, key: str, model: Model) -> DataFrame:
    """mislabelled() of a table of `without_residue`."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        lines, words, ends = _split(batch.column(2))
        counts, made = np.diff(ends), shared.value
        places = [(i, i + 1) for i in range(len(counts))]
        decided = _stretches(places, lines, counts, made.sums(_places(words, made), ends))
        rows = [(i, *c) for i, (f, n) in enumerate(zip(decided, batch.column(1).to_pylist())) for c in cases(f, n)]
        return [r[0] for r in rows], [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())]

    kind = dict(table.dtypes)[key]
    return _run(table, [F.col(key), F.col("_l"), F.col("_words")], [key, "lang", "confidence"], f"{key} {kind}, lang string, confidence double", work)
