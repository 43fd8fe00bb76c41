"""Near-duplicate captures: sequence similarity against the newest earlier rows of a platform and namespace."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from recolta.functions import text as T, urls as U
from recolta.operators.skew import broadcast_if_small
from recolta.session import materialize


def similarity(a: str, b: str) -> float:
    """Ratio of matching subsequences of the lower-case, collapsed texts; 0 for empty ones."""
    a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def near_duplicates(stored: DataFrame, new: DataFrame, threshold: float = 0.82, recent: int = 120) -> DataFrame:
    """(id, duplicate_of, ratio): each new row's first sufficiently similar row among the newest `recent` stored
    rows of its platform and namespace.

    The stored candidates are few per platform and namespace by definition, and are broadcast while they are small together; lengths
    bound the ratio before any text is compared. Null and empty texts have no duplicate.
    """
    key = [U.platform_name(F.col("platform")).alias("p"), F.coalesce("namespace", F.lit("default")).alias("ns")]
    text = F.lower(T.collapse(T.text_or_empty(F.col("text_content"))))
    base = stored.select(*key, "id", "captured_at", text.alias("t")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["p", "ns", "part"], ["p", "ns"]):
        base = base.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("captured_at"), "id"))).filter(F.col("n") <= recent)
    lists = base.groupBy("p", "ns").agg(F.array_sort(F.collect_list(F.struct("n", F.col("id").alias("other"), F.col("t").alias("u")))).alias("c"))
    lists = materialize(lists, "near-dup-candidates")
    near = broadcast_if_small(lists, F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + 64 + F.length(x["u"])))
    pairs = new.select(*key, "id", text.alias("t")).join(near, ["p", "ns"]).select("id", "t", F.explode("c").alias("o")).select("id", "t", "o.*").filter("other <> id")
    short, long = F.least(F.length("t"), F.length("u")), F.length("t") + F.length("u")
    close = pairs.filter((short > 0) & (2 * short / long >= threshold))

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = [SequenceMatcher(None, t, u).ratio() for t, u in zip(b["t"], b["u"])]
            out = b[["id", "n", "other"]].assign(ratio=r)
            yield out[out["ratio"] >= threshold]

    hits = close.mapInPandas(ratios, "id string, n int, other string, ratio double")
    return hits.groupBy("id").agg(F.min(F.struct("n", "other", "ratio")).alias("v")).select("id", F.col("v.other").alias("duplicate_of"), F.round("v.ratio", 6).alias("ratio"))


#: Classes that characters and pairs of characters are counted in.
_CHARS, _PAIRS = 64, 256


def _counts(codes: list[np.ndarray], classes: int) -> np.ndarray:
    return np.stack([np.bincount(c % classes, minlength=classes) for c in codes]).astype(np.int32)


def common_length(masks: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of b and a text of `size` characters, whose places are bits in masks."""
    full = rest = (1 << size) - 1
    for c in b:
        hit = rest & masks.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return size - rest.bit_count()


def first_similar(texts: list[str], own: list[bool], ids: list[str], threshold: float, recent: int) -> list[tuple[str, str, float]]:
    """(id, duplicate_of, ratio) of the own ones of texts in their order, each against the `recent` before it, newest first.

    The matching blocks of SequenceMatcher are a common subsequence, so what bounds its length bounds the ratio. In turn:
    lengths, common characters, common pairs (a subsequence of length L leaves at least 3 L - len(a) - len(b) - 1 of them),
    and the subsequence itself. Classes that share a count can only raise a bound.
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
    size = np.array([len(c) for c in codes])
    chars, pairs = _counts(codes, _CHARS), _counts([c[:-1] * 31 + c[1:] for c in codes], _PAIRS)
    out = []
    for i in range(1, len(texts)):
        if not own[i] or not size[i]:
            continue
        at = np.arange(i - 1, max(0, i - recent) - 1, -1)
        need = np.ceil(threshold * (size[at] + size[i]) / 2 - 1e-9)  # characters in common
        ok = (size[at] > 0) & (np.minimum(size[at], size[i]) >= need)
        at, need = at[ok], need[ok]
        ok = np.minimum(chars[at], chars[i]).sum(1) >= need
        at, need = at[ok], need[ok]
        ok = np.minimum(pairs[at], pairs[i]).sum(1) >= 3 * need - size[at] - size[i] - 1
        masks: dict[str, int] = {}
        for k, c in enumerate(texts[i]):
            masks[c] = masks.get(c, 0) | 1 << k
        for j, least in zip(at[ok], need[ok]):
            if ids[j] == ids[i] or common_length(masks, int(size[i]), texts[j]) < least:
                continue
            ratio = SequenceMatcher(None, texts[i], texts[j]).ratio()
            if ratio >= threshold:
                out.append((ids[i], ids[j], ratio))
                break
    return out


def near_duplicates_within(df: DataFrame, threshold: float = 0.82, recent: int = 120) -> DataFrame:
    """(id, duplicate_of, ratio): each row's first sufficiently similar row among the `recent` rows before it in
    (captured_at, id) of its platform and namespace, newest first.

    Ranks are counted by hour and summed over hours, so no task sorts a whole platform. Blocks of ranks are compared
    by themselves, each with the last `recent` rows of the block before. A row without a time stands before all others.
    The number of partitions is given, since blocks are few bytes but much work, and would be put into one task.
    """
    size = 4 * recent
    text = F.lower(T.collapse(T.text_or_empty(F.col("text_content"))))
    hour = F.coalesce(F.floor(F.unix_seconds(F.col("captured_at")) / 3600), F.lit(-(2**40))).alias("hour")
    rows = df.select(U.platform_name(F.col("platform")).alias("p"), F.coalesce("namespace", F.lit("default")).alias("ns"), hour, "captured_at", "id", text.alias("t"))
    sums = F.sum("n").over(W.partitionBy("p", "ns").orderBy("hour").rowsBetween(W.unboundedPreceding, -1))
    before = rows.groupBy("p", "ns", "hour").agg(F.count(F.lit(1)).alias("n")).select("p", "ns", "hour", F.coalesce(sums, F.lit(0)).alias("before"))
    inner = F.row_number().over(W.partitionBy("p", "ns", "hour").orderBy("captured_at", "id")) - 1
    ranked = rows.withColumn("inner", inner).join(before, ["p", "ns", "hour"]).withColumn("rank", F.col("before") + F.col("inner"))
    block, place = F.floor(F.col("rank") / size), F.col("rank") % size
    copies = F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.when(place >= size - recent, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))
    sent = ranked.select("p", "ns", "rank", "id", "t", F.explode(F.array_compact(copies)).alias("x")).select("p", "ns", "rank", "id", "t", "x.*")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rank")
        found = first_similar(b["t"].tolist(), b["own"].tolist(), b["id"].tolist(), threshold, recent) if b["own"].any() else []
        return pd.DataFrame(found, columns=["id", "duplicate_of", "ratio"])

    spread = sent.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p", "ns", "block")
    hits = spread.groupBy("p", "ns", "block").applyInPandas(compare, "id string, duplicate_of string, ratio double")
    return hits.select("id", "duplicate_of", F.round("ratio", 6).alias("ratio"))
