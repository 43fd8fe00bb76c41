"""One consistent form for texts that look the same (problem 2).

Arrow text becomes flat code-point arrays; a lookup table maps each code point to nothing, to one
code point or to several (expansion offsets), marks are put in canonical order and composed again,
all by array operations over a whole batch.

What changes: letters of another width or font style, no-break and other kinds of space, invisible
characters, look-alike letters of other scripts (to the Latin letter), ligatures and Roman numeral
signs (to their letters), and separate combining marks (composed). What stays apart: letter case,
accents, raised and circled characters, punctuation, and the number of spaces. A zero-width joiner
between two emoji stays, since without it they are drawn apart. Null stays null, empty stays empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recolta.llm import arrow_text as A
from recolta.operators.skew import SALTS, heavy_threshold, join_unique
from recolta.session import materialize

# Letters of other scripts and the Latin letter that they look like.
LOOK_ALIKES = """
а=a е=e о=o р=p с=c у=y х=x і=i ј=j ѕ=s ԁ=d һ=h ԛ=q ԝ=w ѵ=v ӏ=l
А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X Ѕ=S І=I Ј=J Ү=Y Ѵ=V Ԛ=Q Ԝ=W Ԍ=G Ӏ=I
α=a ι=i ν=v ο=o ρ=p υ=u ϲ=c ϳ=j
Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X Ϲ=C Ϳ=J
օ=o ս=u հ=h ո=n ց=g զ=q յ=j Օ=O Ս=U Տ=S
ɑ=a ɡ=g ᴄ=c ᴏ=o ᴠ=v ᴡ=w ᴢ=z ꜱ=s
Ꭺ=A Ᏼ=B Ꮯ=C Ꭰ=D Ꭼ=E Ꮐ=G Ꮋ=H Ꭻ=J Ꮶ=K Ꮮ=L Ꮇ=M Ꮲ=P Ꭱ=R Ꮪ=S Ꭲ=T Ꮩ=V Ꮃ=W Ꮓ=Z
ꓮ=A ꓐ=B ꓚ=C ꓓ=D ꓰ=E ꓝ=F ꓖ=G ꓧ=H ꓲ=I ꓙ=J ꓗ=K ꓡ=L ꓟ=M ꓠ=N ꓳ=O ꓑ=P ꓣ=R ꓢ=S ꓔ=T ꓴ=U ꓦ=V ꓪ=W ꓫ=X ꓬ=Y ꓜ=Z
"""
#: Blocks whose code points can fold; all others (ideographs, syllables, private use) stand for themselves.
_BLOCKS = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
#: Fillers and variation selectors: drawn as nothing though they are no format characters.
_UNSEEN = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_LINE_ENDS = {0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}
_ZWJ = 0x200D
_TOP = 0x110000


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables, built from Unicode's own data by rule.

    single: the one code point that stands for each; length: of its expansion; start: where a longer
    expansion begins in `long`; changes: whether a text with this code point may change at all.
    """
    alike = dict(pair.split("=") for pair in LOOK_ALIKES.split())
    single, length, start = np.arange(_TOP, dtype=np.uint32), np.ones(_TOP, np.uint8), np.zeros(_TOP, np.int32)
    changes, rank = np.zeros(_TOP, bool), np.zeros(_TOP, np.uint8)
    long: list[int] = []
    first, second, whole = [], [], []

    def expand(ch: str) -> str:
        if ch in alike:
            return alike[ch]
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            return ch
        if parts[0][0] == "<":
            letters = parts[0] == "<compat>" and unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Nl") and ch != "ſ"
            if not letters and parts[0] not in ("<wide>", "<narrow>", "<noBreak>", "<font>"):
                return ch
            parts = parts[1:]
        return "".join(expand(chr(int(x, 16))) for x in parts)

    for low, high in _BLOCKS:
        for cp in range(low, high):
            ch = chr(cp)
            kind = unicodedata.category(ch)
            rank[cp] = unicodedata.combining(ch)
            if kind == "Zs" or cp == 9:
                out = " "
            elif cp in _LINE_ENDS:
                out = "\n"
            elif kind == "Cf" or cp in _UNSEEN or kind == "Cc" and cp != 10:
                out = ""
            else:
                out = expand(ch)
                pair = unicodedata.decomposition(ch)
                if pair and pair[0] != "<" and " " in pair and unicodedata.normalize("NFC", ch) == ch:
                    a, b = (int(x, 16) for x in pair.split())
                    if unicodedata.combining(chr(b)):
                        first.append(a), second.append(b), whole.append(cp)
            length[cp] = len(out)
            changes[cp] = out != ch and unicodedata.normalize("NFC", out) != ch or rank[cp] > 0
            if len(out) == 1:
                single[cp] = ord(out)
            elif len(out) > 1:
                start[cp] = len(long)
                long += map(ord, out)
    changes[0x1100:0x1200] = True
    key = (np.array(first, np.int64) << 21) | np.array(second, np.int64)
    order = np.argsort(key)
    return {"single": single, "length": length, "start": start, "long": np.array(long, np.uint32), "changes": changes, "rank": rank, "pair": key[order], "whole": np.array(whole, np.uint32)[order]}


def _is_emoji(points: np.ndarray) -> np.ndarray:
    return ((points >= 0x1F000) & (points < 0x1FC00)) | ((points >= 0x2600) & (points < 0x27C0))


def _kept_joiners(points: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Zero-width joiners between two emoji of one row, across a variation selector."""
    seen = np.flatnonzero(~((points >= 0xFE00) & (points < 0xFE10)))
    kept = np.zeros(len(points), bool)
    if len(seen) > 2:
        p, r = points[seen], row[seen]
        mid = (p[1:-1] == _ZWJ) & _is_emoji(p[:-2]) & _is_emoji(p[2:]) & (r[:-2] == r[1:-1]) & (r[2:] == r[1:-1])
        kept[seen[1:-1][mid]] = True
    return kept


def _compose(points: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order, composed with their base; conjoining jamo joined."""
    rank = t["rank"][points]
    mark = rank > 0
    if mark.any():
        # a base with its marks is one group; marks at the start of a text are a group of their own, whatever stood before
        group = np.cumsum(~mark | np.append(True, row[1:] != row[:-1]))
        order = np.lexsort((np.arange(len(points)), rank, group))
        points, rank, row = points[order], rank[order], row[order]
        mark = rank > 0
        base = np.maximum.accumulate(np.where(mark, -1, np.arange(len(points))))  # of each position; -1 before the first
        own = mark & (base >= 0) & (row == row[np.maximum(base, 0)])  # a mark at the start of a text has no base
        at = np.flatnonzero(own)
        nth, points, keep = at - base[at], points.copy(), np.ones(len(points), bool)
        blocked = np.zeros(len(points), np.int16)  # by base: the rank of its last mark that stayed
        by = np.argsort(nth, kind="stable")
        at, nth = at[by], nth[by]
        for group in np.split(at, np.flatnonzero(np.diff(nth)) + 1):
            b = base[group]
            key = (points[b].astype(np.int64) << 21) | points[group]
            i = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
            fits = (t["pair"][i] == key) & (blocked[b] < rank[group])
            points[b[fits]] = t["whole"][i[fits]]
            keep[group[fits]] = False
            blocked[b[~fits]] = rank[group[~fits]]
        points, row = points[keep], row[keep]
    if ((points >= 0x1100) & (points < 0x1200)).any():
        p = points.astype(np.int64)
        for lead in (True, False):
            if len(p) < 2:
                break
            a, b, near = p[:-1], p[1:], row[:-1] == row[1:]
            if lead:
                hit = near & (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
                made = 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
            else:
                hit = near & (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
                made = a + b - 0x11A7
            at = np.flatnonzero(hit)
            p[at] = made[at]
            keep = np.ones(len(p), bool)
            keep[at + 1] = False
            p, row = p[keep], row[keep]
        points = p.astype(np.uint32)
    return points, row


def fold(column: pa.Array) -> pa.Array:
    """The consistent form of every text of an Arrow string array."""
    column = A.plain(column)
    t = tables()
    points, bounds = A.code_points(column)
    null = A.nulls(column)
    flagged = t["changes"][points]
    if not flagged.any():
        return column
    touched = np.diff(np.concatenate([[0], np.cumsum(flagged)])[bounds]) > 0
    rows = np.flatnonzero(touched)
    where, _ = A.take_rows(bounds, rows)
    p, row = points[where], np.repeat(rows, np.diff(bounds)[rows])
    n = t["length"][p].astype(np.int64)
    n[_kept_joiners(p, row)] = 1
    n[(p == 13) & (np.append(p[1:], 0) == 10) & (np.append(row[1:], -1) == row)] = 0  # CR LF is one line end
    source = np.repeat(np.arange(len(p)), n)
    out = t["single"][p[source]]
    wide = n > 1
    if wide.any():
        out[np.repeat(wide, n)] = t["long"][A.ranges(t["start"][p[wide]].astype(np.int64), n[wide])]
    out, out_row = _compose(out, row[source], t)
    counts = np.diff(bounds)
    counts[rows] = np.bincount(out_row, minlength=len(counts))[rows]
    new_bounds = np.concatenate([[0], np.cumsum(counts)])
    merged = np.empty(int(new_bounds[-1]), np.uint32)
    rest = np.flatnonzero(~touched)
    merged[A.take_rows(new_bounds, rest)[0]] = points[A.take_rows(bounds, rest)[0]]
    merged[A.take_rows(new_bounds, rows)[0]] = out
    return A.to_strings(merged, new_bounds, null)


def visual_forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value, form), one row per row of df and field; null values give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, field in enumerate(fields, 1):
                column = batch.column(i)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([field] * len(batch)), column, fold(column)], ["key", "field", "value", "form"])

    kind = dict(df.dtypes)[key]
    forms = df.select(F.col(key).alias("key"), *[F.col(c).cast("string") for c in fields]).mapInArrow(run, f"key {kind}, field string, value string, form string")
    return forms.filter(F.col("value").isNotNull()).withColumnRenamed("key", key)


def _salted(left: DataFrame, right: DataFrame, on: list[str], n: str, heavy: int) -> DataFrame:
    """left JOIN right; right's rows of a key with `n` >= heavy are spread over salts, left's repeated for each."""
    salt = F.when(F.col(n) >= heavy, F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.explode(F.when(F.col(n) >= heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return left.withColumn("_salt", salts).join(right.withColumn("_salt", salt).drop(n), [*on, "_salt"]).drop("_salt", n)


def _digest(c: str) -> Column:
    return F.unhex(F.md5(F.col(c).cast("binary")))


def lookalike_pairs(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, id_a, id_b): pairs of rows, id_a < id_b, with values that look the same but differ.

    Only pairs of different values are ever formed: distinct values of a form are paired first, and
    each such pair is then joined to its rows, the rarer value before the more frequent one. Rows of
    a value that very many share are spread over salts. Nulls are in no pair; a key that occurs
    twice is paired with other keys only.
    """
    hashed = visual_forms(df, key, fields).select(F.col(key).alias("key"), "field", _digest("form").alias("form"), _digest("value").alias("value")).distinct()
    rows = materialize(hashed, "visual-forms")
    values = rows.groupBy("field", "form", "value").agg(F.count(F.lit(1)).alias("n"))
    several = values.groupBy("field", "form").agg(F.count(F.lit(1)).alias("v")).filter(F.col("v") > 1)
    mixed = materialize(values.join(several, ["field", "form"]), "visual-values")  # only forms written in several ways
    heavy = heavy_threshold(rows.count())
    a = mixed.select("field", "form", "v", F.col("value").alias("value_a"), F.col("n").alias("n_a"))
    b = mixed.select("field", "form", "v", F.col("value").alias("value_b"), F.col("n").alias("n_b"), F.col("value").alias("key"))
    rarer = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("value_a") < F.col("value_b")))
    pairs = _salted(a, b, ["field", "form"], "v", heavy).drop("key").filter(rarer)
    named = ["field", "form", "value"]
    mine = materialize(join_unique(rows, mixed.select(*named, "n"), named, mixed.select(*named, F.col("n").alias("_n")), F.col("key"), least=heavy), "visual-rows")
    one = _salted(pairs.withColumn("n", F.col("n_a")).withColumnRenamed("value_a", "value"), mine, named, "n", heavy)
    one = one.select("field", "form", F.col("value_b").alias("value"), F.col("n_b").alias("n"), F.col("key").alias("key_a"))
    two = _salted(one, mine, named, "n", heavy)
    return two.filter(F.col("key_a") != F.col("key")).select("field", F.least("key_a", "key").alias("id_a"), F.greatest("key_a", "key").alias("id_b")).distinct()
