"""Copies that differ in formatting only (problem 5).

Two records are copies if each of their fields is equal when white space, letter case, punctuation
and the order of sub-fields are disregarded. A lookup table tells for each byte whether it is
skipped, folded or a separator; the bytes that remain run into polynomial hashes modulo a prime, one
per sub-field, whose mixed sum is the same in any order. Canonical strings are never made. Rows with
equal hashes are then compared with their group's representative by two pointers that skip and fold
as the table says; a group in which the hashes lied is split again by exact comparison.

Sub-fields are the parameters of a url (after the first '?', between '&', ';' and '#') and, in a key
that has a '=', what stands between ';', '&', '|', ',' and line ends. Empty sub-fields don't count.

Defined cases: null equals nothing, so a row with a null field is its own record; a field without
any letter or digit is empty, and empty equals empty; ties are impossible since the smallest id
represents; an id that occurs twice counts as one more copy; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recolta.llm import arrow_text as A
from recolta.operators.skew import heavy_threshold, join_unique
from recolta.session import materialize

#: The primes of the two hashes, and their bases. A product of two residues fits 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 69_069_069)
SKIP = 0
_SEPARATORS = {"url": "&;#", "key": ";&|,\n\r"}


@lru_cache(maxsize=1)
def skip_and_fold() -> np.ndarray:
    """For each code point 0 if it is skipped, else its folded value. Letters, digits and marks remain."""
    table = np.zeros(0x110000, np.uint32)
    for low, high in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000)):
        for cp in range(low, high):
            ch = chr(cp)
            if unicodedata.category(ch)[0] in "LNMS" and not (cp < 128 and not ch.isalnum()):
                small = ch.lower()
                table[cp] = ord(small) if len(small) == 1 else cp
    for low, high in ((0x3400, 0xA000), (0xAC00, 0xD800), (0x20000, 0x110000)):
        table[low:high] = np.arange(low, high)
    return table


def _layout(points: np.ndarray, bounds: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its folded value (0: skipped), its row, and whether a new sub-field begins there."""
    folded = skip_and_fold()[points]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    separator = np.isin(points, np.array([ord(c) for c in _SEPARATORS[kind]], np.uint32))
    mark = points == ord("?" if kind == "url" else "=")
    seen = np.concatenate([[0], np.cumsum(mark)])
    if kind == "url":  # separators count behind the first question mark, which is one itself
        before = seen[:-1] - seen[bounds[row]]
        cut = np.where(before > 0, separator, mark)
    else:
        cut = separator & (np.diff(seen[bounds])[row] > 0)
    return folded, row, cut


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    width = 1
    while width < n:
        step = min(width, n - width)
        factor = np.uint64(int(out[width - 1]) * base % prime)
        out[width : width + step] = out[:step] * factor % np.uint64(prime)
        width += step
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hashes(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text, equal for texts that are copies."""
    points, bounds = A.code_points(column)
    rows = len(bounds) - 1
    folded, row, cut = _layout(points, bounds, kind)
    begins = cut.copy()
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    part = np.cumsum(begins) - 1
    head = np.ones(int(part[-1]) + 1 if len(part) else 0, bool)
    if kind == "url":  # what stands before the parameters is no parameter
        head[part[cut]] = False
    kept = np.flatnonzero(folded)
    value, segment = folded[kept].astype(np.uint64), part[kept]
    first = np.concatenate([[True], segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(kept)))
    position = np.arange(len(kept)) - np.repeat(starts, sizes)
    owner, is_head = row[kept][starts], head[segment[starts]]
    out = []
    for prime, base in zip(PRIMES, BASES):
        power = _powers(int(sizes.max(initial=1)), base, prime)
        terms = (value + np.uint64(1)) * power[position] % np.uint64(prime)
        sums = np.add.reduceat(terms, starts) % np.uint64(prime) if len(starts) else terms
        mixed = _mix(sums * np.uint64(2) + is_head + _mix(sizes.astype(np.uint64)))
        total = np.zeros(rows, np.uint64)
        np.add.at(total, owner, mixed)
        out.append(total.view(np.int64))
    return out[0], out[1]


def _folded_parts(text: str, kind: str) -> list[tuple[int, int]]:
    """(begin, end) of the sub-fields of a text; the first of a url is its head."""
    cuts, inside = [0], kind == "key" and "=" in text
    for i, ch in enumerate(text):
        if kind == "url" and not inside:
            if ch == "?":
                inside = True
                cuts.append(i)
        elif inside and ch in _SEPARATORS[kind]:
            cuts.append(i)
    return list(zip(cuts, [*cuts[1:], len(text)]))


def _same_span(a: str, i: int, m: int, b: str, j: int, n: int, table: np.ndarray) -> bool:
    """Whether a[i:m] and b[j:n] are equal after skipping and folding, by two pointers."""
    while True:
        while i < m and not table[ord(a[i])]:
            i += 1
        while j < n and not table[ord(b[j])]:
            j += 1
        if i == m or j == n:
            return i == m and j == n
        if table[ord(a[i])] != table[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def same_record(a: str, b: str, kind: str) -> bool:
    """Exact comparison of two texts: the heads in place, the other sub-fields in any order."""
    if a == b:
        return True
    table = skip_and_fold()
    left, right = _folded_parts(a, kind), _folded_parts(b, kind)
    if kind == "url":
        if not _same_span(a, *left[0], b, *right[0], table):
            return False
        left, right = left[1:], right[1:]
    full = lambda text, spans: [s for s in spans if any(table[ord(text[k])] for k in range(*s))]
    left, right = full(a, left), full(b, right)
    if len(left) != len(right):
        return False
    key = lambda text: lambda s: [int(table[ord(c)]) for c in text[s[0] : min(s[1], s[0] + 64)] if table[ord(c)]]
    if len(left) > 1:  # nearly in place already: the order of the first letters
        left, right = sorted(left, key=key(a)), sorted(right, key=key(b))
    left, free = list(left), list(right)
    for s in left:
        hit = next((k for k, r in enumerate(free) if _same_span(a, *s, b, *r, table)), None)
        if hit is None:
            return False
        free.pop(hit)
    return True


def _canonical(text: str, kind: str) -> str:
    """The exact canonical string, only for the rows of a group whose hashes lied."""
    table = skip_and_fold()
    spans = _folded_parts(text, kind)
    parts = ["".join(chr(table[ord(c)]) for c in text[s:e] if table[ord(c)]) for s, e in spans]
    head, rest = (parts[:1], parts[1:]) if kind == "url" else ([], parts)
    return "\x00".join([*head, *sorted(p for p in rest if p)])


def hashed(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(id, f0.., h0, h1): the rows without null fields, with the two hashes of all their fields."""
    kinds = list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)]
            for i, kind in enumerate(kinds, 1):
                for j, h in enumerate(rolling_hashes(batch.column(i), kind)):
                    total[j] = _mix(total[j] * np.uint64(31) + h.view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(t.view(np.int64)) for t in total]], names)

    columns = [f"f{i}" for i in range(len(fields))]
    names = ["id", *columns, "h0", "h1"]
    rows = df.select(F.col(key).cast("string").alias("id"), *[F.col(c).cast("string").alias(n) for c, n in zip(fields, columns)]).dropna()
    return rows.mapInArrow(run, ", ".join(["id string", *[f"{c} string" for c in columns], "h0 long", "h1 long"]))


def copies(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(first_id, id) for every copy other than the smallest id of its group.

    fields: column -> 'url' or 'key'. Hashes are counted per group before anything is joined; only
    rows of groups with several rows meet their representative, large groups spread over salts.
    """
    kinds = list(fields.values())
    columns = [f"f{i}" for i in range(len(fields))]
    rows = materialize(hashed(df, key, fields), "copies-hashed")
    on = ["h0", "h1"]
    groups = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("first_id")).filter(F.col("_n") > 1)
    groups = materialize(groups, "copies-groups")
    heavy = heavy_threshold(rows.count())
    members = join_unique(rows, groups.select(*on, "first_id"), on, groups.select(*on, "_n"), F.col("id"), least=heavy)
    first = members.filter(F.col("id") == F.col("first_id")).groupBy(*on).agg(*[F.min(c).alias(f"first_{c}") for c in columns])
    compared = join_unique(members.filter(F.col("id") != F.col("first_id")), first, on, groups.select(*on, "_n"), F.col("id"), least=heavy)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            same = np.ones(len(batch), bool)
            for c, kind in zip(columns, kinds):
                a, b = at[c].to_pylist(), at[f"first_{c}"].to_pylist()
                for i in range(len(batch)):
                    same[i] = same[i] and same_record(a[i], b[i], kind)
            # a row that is no copy of the first carries its exact canonical form instead
            other = [None if s else "\x01".join(_canonical(at[c][i].as_py(), k) for c, k in zip(columns, kinds)) for i, s in enumerate(same)]
            yield pa.RecordBatch.from_arrays([at["first_id"], at["id"], pa.array(other, pa.string())], ["first_id", "id", "other"])

    checked = materialize(compared.mapInArrow(verify, "first_id string, id string, other string"), "copies-checked")
    equal = checked.filter(F.col("other").isNull()).select("first_id", "id")
    lied = checked.filter(F.col("other").isNotNull())
    split = lied.groupBy("other").agg(F.min("id").alias("own_first"))
    again = lied.join(split, "other").filter(F.col("id") != F.col("own_first")).select(F.col("own_first").alias("first_id"), "id")
    return equal.unionByName(again).distinct()


def records(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(id, copies): one row per record under its smallest id, with the number of rows stored for it."""
    found = copies(df, key, fields)
    extra = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    owner = extra.join(found, "id", "left").select(F.coalesce("first_id", "id").alias("id"), "rows")
    return owner.groupBy("id").agg(F.sum("rows").alias("copies"))
