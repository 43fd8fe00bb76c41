"""Readers of the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "items", "feed_items", "memory_nodes", "memory_edges", "memory_events", "eval_items",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, as a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views of all tables, for plain spark.sql."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
