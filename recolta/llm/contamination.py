"""Evaluation texts leaking into training text (problem 9).

The normalised words of the test items are built into generalised suffix automata. Documents
stream through them: at each word the length of the longest passage that ends there and occurs in some
item is tracked. Where it reaches the length limit, the items that contain the last `least` words are
reported; where it covers a whole item of COVERED words or more that is shorter than that, the coverage limit
reports the item, if asked for. The whole matched spans can be cut out of the text.

Normalised: texts in their consistent visual form (hidden characters, width of letters, look-alike letters, composed
accents), then letters and digits in lower case; apostrophes inside words vanish, all else separates words.

An automaton is built over PART_WORDS words of whole items at most and then frozen into sorted arrays of some 60 bytes a word. As
many automata as hold BROADCAST_WORDS words are broadcast together; more items take further passes over the documents,
whose results are united, so neither the driver nor a worker holds more than that at once. Words of a document walk
through an automaton only in runs that are long enough and of which each two neighbours stand in an item.

Defined cases: null, empty and short texts contain nothing; repeated documents give their rows
again; an item shorter than the limits can't be found; repeated items are found each; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recolta.llm.pii import visible
from recolta.session import materialize

#: Fewest consecutive words that count as a leak, and fewest words of an item that counts when it is covered as a whole.
LEAST_WORDS, COVERED = 12, 5
#: Words of items in one automaton, which bounds what building it takes, and in the automata of one broadcast.
PART_WORDS, BROADCAST_WORDS = 200_000, 4_000_000
#: Words as they stand in texts that a worker keeps.
CACHED_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+(?:['’ʼ＇][^\W_]+)*")


def words(text: str) -> list[tuple[str, int, int]]:
    """(normalised word, begin, end) of a text; positions are those of the text as given."""
    seen, at = visible(text)
    found = [(_plain(m[0]), m.start(), m.end()) for m in _WORD.finditer(seen)]
    return found if at is None else [(w, at[a], at[b - 1] + 1) for w, a, b in found]


def _plain(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


class _Seen(dict):
    """The number of each word as it stands in a text, -1 for one that no item holds."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, word: str) -> int:
        self[word] = made = self.number.get(_plain(word), -1)
        return made

    def __reduce__(self) -> tuple:
        return _Seen, (self.number,)


class Automaton:
    """Generalised suffix automaton over the word numbers of some items; frozen, its edges are sorted arrays."""

    def __init__(self, items: list[tuple[int, str]], least: int, covered: int | None = None) -> None:
        self.least, self.floor = least, min(least, covered or least)
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[list[int]] = [[]]
        whole: list[tuple[int, int, int]] = []
        for item, text in items:
            last = n = 0
            for w, _, _ in words(text or ""):
                last, n = self._extend(last, self.number.setdefault(w, len(self.number)), owners), n + 1
                if not owners[last] or owners[last][-1] != item:
                    owners[last].append(item)
            if covered and covered <= n < least:
                whole.append((last, n, item))
        self._freeze(owners, whole)

    def _freeze(self, owners: list[list[int]], whole: list[tuple[int, int, int]]) -> None:
        """Edges as sorted keys (state, word); the items of a state are those of all states below it in the tree of
        suffix links, which lie next to one another in the order of a walk through that tree."""
        size = np.array([len(e) for e in self.next])
        state = np.repeat(np.arange(len(size)), size)
        word = np.fromiter((w for e in self.next for w in e), np.int64, size.sum())
        goal = np.fromiter((t for e in self.next for t in e.values()), np.int64, size.sum())
        key = (state << 32) | word
        order = np.argsort(key)
        self.edges, self.goals = key[order], goal[order].astype(np.int32)
        self.root = np.zeros(len(self.number) + 1, np.int64)  # the state after each word; its last place is for unknown ones
        self.root[[*self.next[0]]] = [*self.next[0].values()]
        self.links, self.lengths = np.array(self.link, np.int32), np.array(self.length, np.int32)
        below: list[list[int]] = [[] for _ in self.link]
        for s, parent in enumerate(self.link):
            if parent >= 0:
                below[parent].append(s)
        begin, end, flat = np.zeros(len(below), np.int32), np.zeros(len(below), np.int32), []
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                end[s] = len(flat)
                continue
            begin[s] = len(flat)
            if self.length[s] >= self.floor:  # shorter passages are never reported
                flat += owners[s]
            stack.append((s, True))
            stack += [(x, False) for x in below[s]]
        self.begin, self.end, self.owners = begin, end, np.array(flat)
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for s, n, item in whole:
            self.whole.setdefault(s, []).append((n, item))
        del self.next, self.link, self.length
        self.seen = _Seen(self.number)

    def items_of(self, state: int) -> set:
        return set(self.owners[self.begin[state] : self.end[state]].tolist())

    def runs(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Where at least `floor` words follow one another of which each two neighbours stand in an item: two steps of the
        automaton for all places at once. Nothing is found elsewhere."""
        if self.floor < 2:
            return [(0, len(numbers))]
        key = (self.root[numbers[:-1]] << 32) | numbers[1:]
        at = np.minimum(self.edges.searchsorted(key), len(self.edges) - 1)
        known = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (self.edges[at] == key) if len(self.edges) else np.zeros(len(key), bool)
        gaps = np.flatnonzero(~np.concatenate([[False], known, [False]]))
        wide = np.flatnonzero(np.diff(gaps) >= self.floor)
        return [(int(a), int(b)) for a, b in zip(gaps[wide], gaps[wide + 1])]

    def step(self, state: int, word: int) -> int:
        """The state after a word, -1 if there is none."""
        key = (state << 32) | word
        at = int(self.edges.searchsorted(key))
        return int(self.goals[at]) if at < len(self.edges) and self.edges[at] == key else -1

    def _state(self, length: int, owners: list[list[int]]) -> int:
        self.next.append({}), self.link.append(-1), self.length.append(length), owners.append([])
        return len(self.link) - 1

    def _extend(self, last: int, word: int, owners: list[list[int]]) -> int:
        present = self.next[last].get(word)
        if present is not None and self.length[present] == self.length[last] + 1:
            return present
        if present is not None:
            return self._split(last, word, present, owners)
        state = self._state(self.length[last] + 1, owners)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q, owners)
        return state

    def _split(self, p: int, word: int, q: int, owners: list[list[int]]) -> int:
        clone = self._state(self.length[p] + 1, owners)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def matches(self, numbers: list[int]) -> list[int]:
        """At each word the length of the longest passage that ends there and occurs in an item."""
        return [n for n, _ in self._walk(numbers)]

    def _walk(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        state, n = 0, 0
        for w in numbers:
            while (to := self.step(state, w)) < 0 and state:
                state = int(self.links[state])
                n = int(self.lengths[state])
            state, n = (to, n + 1) if to >= 0 else (0, 0)
            yield n, state

    def find(self, numbers: list[int]) -> tuple[set[int], list[tuple[int, int]]]:
        """(items found, spans of word positions covered by passages of at least `least` words or by a whole item)."""
        found: set[int] = set()
        spans: list[tuple[int, int]] = []
        for at, (n, state) in enumerate(self._walk(numbers)):
            if n < self.floor:
                continue
            begin = at + 1
            if n >= self.least:
                begin = at + 1 - n
                while self.lengths[self.links[state]] >= self.least:  # the state of the last `least` words
                    state = int(self.links[state])
                found |= self.items_of(state)
            if self.whole:
                while state and self.lengths[state] >= self.floor:  # suffixes that are whole items
                    for m, item in self.whole.get(state, ()):
                        if m <= n:
                            found.add(item)
                            begin = min(begin, at + 1 - m)
                    state = int(self.links[state])
            if begin > at:
                continue
            while spans and begin <= spans[-1][1]:
                begin = min(begin, spans.pop()[0])
            spans.append((begin, at + 1))
        return found, spans


def automata(items: DataFrame, item_key: str, item_text: str, least: int = LEAST_WORDS, covered: int | None = None, part: int = PART_WORDS, most: int = BROADCAST_WORDS) -> Iterator[list[Automaton]]:
    """Lists of automata of at most `most` words together (or one item). Items arrive partition by partition."""
    texts = items.select(F.col(item_key).alias("k"), F.col(item_text).cast("string").alias("t")).filter(F.col("t").isNotNull() & F.col("k").isNotNull())
    made: list[Automaton] = []
    own: list[tuple[int, str]] = []
    size = total = 0
    for r in texts.toLocalIterator():
        n = len(words(r.t))
        if own and size + n > part:
            made.append(Automaton(own, least, covered))
            own, total, size = [], total + size, 0
            if total + n > most:
                yield made
                made, total = [], 0
        own.append((r.k, r.t))
        size += n
    if own:
        made.append(Automaton(own, least, covered))
    if made:
        yield made


def _scan(made: list[Automaton] | Automaton, text: str | None) -> tuple[set[int], list[tuple[int, int]]]:
    """(items, character spans) found in a text."""
    if not text:
        return set(), []
    raw = _WORD.findall(visible(text)[0])
    found: list[tuple[str, int, int]] = []
    items: set[int] = set()
    spans: list[tuple[int, int]] = []
    for one in [made] if isinstance(made, Automaton) else made:
        if len(raw) < one.floor:
            continue
        if len(one.seen) > CACHED_WORDS:
            one.seen.clear()
        numbers = list(map(one.seen.__getitem__, raw))
        for a, b in one.runs(np.array(numbers)):
            found = found or words(text)
            got, where = one.find(numbers[a:b])
            items |= got
            spans += [(found[a + s][1], found[a + e - 1][2]) for s, e in where]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return items, merged


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST_WORDS, covered: int | None = None, part: int = PART_WORDS, most: int = BROADCAST_WORDS) -> DataFrame:
    """(key, item key): each document and item that share `least` consecutive words or more; with `covered`, also each
    document with the whole of an item that has as many words as that, but fewer than `least`."""
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    item_type = pa.string() if item_kind == "string" else pa.int64()
    source = docs.select(key, F.col(text).cast("string").alias("_text"))

    def passed(made: list[Automaton]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, hit = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for item in sorted(_scan(shared.value, t)[0]):
                        at.append(i), hit.append(item)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hit, item_type)], [key, item_key])

        return source.mapInArrow(run, f"{key} {kind}, {item_key} {item_kind}")

    # a pass that others follow is written at once, so that its automata need not stay
    parts: list[DataFrame] = []
    before: list[Automaton] | None = None
    for made in automata(items, item_key, item_text, least, covered, part, most):
        if before is not None:
            parts.append(materialize(passed(before), "leaks"))
        before = made
    parts.append(passed(before or []))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def cleaned(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST_WORDS, most_share: float = 0.5, covered: int | None = COVERED, part: int = PART_WORDS, most: int = BROADCAST_WORDS) -> DataFrame:
    """(key, text, removed): documents with leaked spans cut out, by the limits of length and coverage. A document of which
    more than `most_share` of the characters leaked gets a null text: it is to be dropped as a whole. Items beyond one
    broadcast are cut out in further passes, each of which judges what the last one left."""
    kind = dict(docs.dtypes)[key]

    def one(made: list[Automaton], t: str | None, before: int) -> tuple[str | None, int]:
        _, spans = _scan(made, t)
        removed = sum(b - a for a, b in spans)
        if not removed:
            return t, before
        if before + removed > most_share * (len(t) + before):
            return None, before + removed
        parts, last = [], 0
        for a, b in spans:
            parts.append(t[last:a])
            last = b
        return "".join([*parts, t[last:]]), before + removed

    def passed(source: DataFrame, made: list[Automaton]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [one(shared.value, t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], [key, "text", "removed"])

        return source.mapInArrow(run, f"{key} {kind}, text string, removed long")

    out = docs.select(key, F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("removed"))
    before: list[Automaton] | None = None
    for made in automata(items, item_key, item_text, least, covered, part, most):
        if before is not None:
            out = materialize(passed(out, before), "cleaned")
        before = made
    return passed(out, before or [])
