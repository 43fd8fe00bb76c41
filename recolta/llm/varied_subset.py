"""Choosing a varied subset of given size (problem 1).

Records are binned into the cells of a grid over several attributes. Within a cell they are ranked;
then all are ordered by rank and by cell, and the first k are chosen: a round-robin over cells that
mirrors no large group. Only Spark SQL.

The order of the cells of one rank is itself a round-robin: by how many cells of that rank came before
in the finest attribute's value, among equal ones in the next attribute's, and so on; of the coarsest attribute
all cells of the round that came before count. So cells of a cluster not met yet come first, then those of a group
not met yet, and platforms take turns over the whole round.

Only what can still be chosen is sorted. At every step the sizes of the groups tell the rank R up to which
k records are reached: groups give their first R records, those of lower rank are chosen, and only those of rank R
go on to the next step. A group's first R are taken in salted parts first, so no task sees a whole large group.

Defined cases: keys are chosen once, the row of highest score (then greatest attributes) standing
for a repeated key; null attributes are one value of their own; spelling of an attribute counts
without case and outer blanks; null keys are not chosen; equal ranks are ordered by hash of the key;
k beyond the number of keys gives all, k <= 0 none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from recolta.operators.skew import SALTS
from recolta.session import materialize

#: Bits of the hash that orders keys of equal rank.
HASH_BITS = 60


def _bin(c: str) -> Column:
    """An attribute's value for the grid: without case and outer blanks, null apart from all strings."""
    text = F.col(c).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.lower(F.trim(text))))


def fair_share(sizes: DataFrame, k: int) -> tuple[int, int]:
    """(r, taken): the least r for which all groups together hold k records of rank r or less, and how many records
    have a lower rank. sizes: one row per group with its size n.

    Computed over the histogram of sizes, which has as many rows as there are different sizes up to k; one row comes back.
    """
    hist = sizes.groupBy(F.least("n", F.lit(k)).alias("n")).agg(F.count(F.lit(1)).alias("g"))
    upto = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    after = W.orderBy("n").rowsBetween(1, W.unboundedFollowing)
    larger = F.coalesce(F.sum("g").over(after), F.lit(0))
    filled = hist.withColumn("larger", larger).withColumn("s", F.sum(F.col("n") * F.col("g")).over(upto) + F.col("n") * F.col("larger"))
    prior = lambda c: F.coalesce(F.lag(c).over(W.orderBy("n")), F.lit(0))
    steps = filled.select("n", "s", prior("n").alias("n0"), prior("s").alias("s0"), (F.col("g") + F.col("larger")).alias("open"))
    round_ = F.least("n", F.col("n0") + F.ceil((F.lit(k) - F.col("s0")) / F.col("open"))).cast("long").alias("r")
    reached = steps.filter(F.col("s0") < k).orderBy(F.desc("n")).select(round_, (F.col("s0") + (round_ - 1 - F.col("n0")) * F.col("open")).cast("long").alias("taken"))
    one = reached.first()
    return (int(one.r), int(one.taken)) if one else (0, 0)


def first_in_group(df: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """The first `most` rows of every group by _h and _key, with their rank. Salted parts give their first ones before."""
    order = ["_h", "_key"]
    part = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))
    parts = df.withColumn("_salt", F.pmod(F.col("_h"), F.lit(SALTS)).cast("int")).withColumn("_part", part).filter(F.col("_part") <= most).drop("_part", "_salt")
    return parts.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)


def choose(df: DataFrame, key: str, attributes: list[str], k: int, score: str | None = None) -> DataFrame:
    """(key, turn): k different keys that cover the attributes' values as evenly as possible, and the round of the
    grid in which each was chosen. attributes: from the finest (a cluster) to the coarsest (a platform)."""
    names = [f"_a{i}" for i in range(len(attributes))]
    bins = [_bin(c).alias(n) for c, n in zip(attributes, names)]
    best = F.col(score).cast("double") if score else F.lit(0.0)
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.coalesce(best, F.lit(float("-inf"))).alias("_s"), *bins)
    one = rows.groupBy("_key").agg(F.max(F.struct("_s", *names)).alias("v")).select("_key", *[f"v.{n}" for n in names])
    hashed = F.conv(F.substring(F.md5(F.col("_key").cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    pool = materialize(one.withColumn("_h", hashed), "subset-keys")
    coarse = names[-1]
    left, chosen = max(0, k), pool.limit(0).select("_key", coarse, F.lit(0).cast("long").alias("turn"))
    for i, keys in enumerate([names, *[[n] for n in names[:-1]]]):
        most, taken = fair_share(pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), left)
        ranked = first_in_group(pool, keys, most, "_r")
        if not i:
            round_, ranked = most, ranked.withColumn("turn", F.col("_r").cast("long"))
        ranked = materialize(ranked, "subset-ranked")
        chosen = chosen.unionByName(ranked.filter(F.col("_r") < most).select("_key", coarse, "turn"))
        pool, left = ranked.filter(F.col("_r") == most).drop("_r"), left - taken
    met = chosen.filter(F.col("turn") == round_).groupBy(coarse).agg(F.count(F.lit(1)).alias("_met"))  # at most k rows
    ranked = first_in_group(pool, [coarse], left, "_r").join(met, coarse, "left")
    last = ranked.orderBy(F.col("_r") + F.coalesce("_met", F.lit(0)), coarse).limit(left)
    return chosen.select("_key", "turn").unionByName(last.select("_key", "turn")).select(F.col("_key").alias(key), "turn")
