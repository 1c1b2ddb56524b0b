"""Parquet table access. Column lists are explicit so the scan's ReadSchema is pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuneforge.session import spread


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A pruned scan. A file that gives fewer splits than half the cluster's slots (e.g. one row
    group) is hash-partitioned, so that per-row work is not done by a single task; larger inputs
    are not shuffled. No operator's result depends on partitions, so only the time differs."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    slots = spark.sparkContext.defaultParallelism
    return spread(df) if df.rdd.getNumPartitions() * 2 <= slots else df
