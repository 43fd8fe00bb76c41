"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of one key from which it counts as heavy, and the parts that a heavy key is split into.
HEAVY_ROWS = 20_000
SALTS = 32
#: However many rows there are, at most so many keys count as heavy, which bounds what is broadcast about them.
MOST_HEAVY = 4096


def heavy_threshold(rows: int) -> int:
    """Rows from which a key is heavy, among `rows` in all."""
    return max(HEAVY_ROWS, rows // MOST_HEAVY)


def join_unique(facts: DataFrame, dim: DataFrame, on: list[str], counts: DataFrame, row_id: Column, how: str = "inner", salts: int = SALTS, least: int = HEAVY_ROWS) -> DataFrame:
    """facts JOIN dim ON `on`, where dim has one row per key and counts (on, _n) the rows of facts per key.

    A key with `least` facts or more is split: its facts get one of `salts` salts by a hash of row_id
    and its dim row is repeated once per salt, so no task receives the whole key. counts must hold
    every key of dim; a key without facts needs no row.
    """
    heavy = F.col("_n") >= least
    sized = dim.join(counts.select(*on, "_n"), on, "left")
    spread = sized.withColumn("_salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1))))).drop("_n")
    hot = counts.filter(heavy).select(*on, F.lit(True).alias("_hot"))  # bounded by MOST_HEAVY with heavy_threshold()
    salted = facts.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")).otherwise(F.lit(-1))).drop("_hot")
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


#: Bytes of text up to which a table is broadcast.
MOST_BROADCAST_BYTES = 64 * 2**20


def broadcast_if_small(df: DataFrame, size: Column, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the sum of `size` over its rows is at most `most`; otherwise df as it is, for a shuffle
    join whose skewed keys are split at run time. Materialise df first: it is read here."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if total <= most else df
