"""Planted training tables built from the driver's parquet tables.

The synthetic driver tables carry almost no learnable signal, so targets are computed
from row identity and a few columns. Every fixture exists twice: as DataFrame code and
as the equivalent DuckDB SQL used by the oracle; both must produce identical values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.functions.hashing import hash_below, hash_uniform, hash_uniform_sql, row_key, row_key_sql
from tuneforge.sources.tables import read_table

LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# split seeds: test fraction 0.1, then validation 0.25 of the remainder (usage pattern of the reference)
TEST_FRACTION, VAL_FRACTION = 0.1, 0.25
SEED_TARGET, SEED_TARGET2, SEED_TEST, SEED_VAL = 1, 2, 11, 12


def lineitem_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with key, features, planted targets ``reg``/``reg_positive``/``cls`` and ``split``."""
    li = read_table(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"] + LINEITEM_FEATURES,
    )
    key = row_key()
    df = li.select(key.alias("key"), *LINEITEM_FEATURES)
    u = hash_uniform(SEED_TARGET, F.col("key"))
    u2 = hash_uniform(SEED_TARGET2, F.col("key"))
    reg = (
        F.lit(0.02) * F.col("l_quantity")
        + F.when(F.col("l_discount") > 0.05, F.lit(0.5)).otherwise(F.lit(0.0))
        + F.lit(0.1) * (u - F.lit(0.5))
    )
    df = df.withColumn("reg", reg)
    df = df.withColumn("reg_positive", F.exp(F.col("reg")))
    df = df.withColumn(
        "cls", F.when(F.col("reg") + F.lit(0.5) * (u2 - F.lit(0.5)) > 0.75, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    split = (
        F.when(hash_below(TEST_FRACTION, SEED_TEST, F.col("key")), F.lit("test"))
        .when(hash_below(VAL_FRACTION, SEED_VAL, F.col("key")), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return df.withColumn("split", split)


def lineitem_planted_sql() -> str:
    """DuckDB twin of :func:`lineitem_planted` (a sub-query named ``li``)."""
    u = hash_uniform_sql(SEED_TARGET, "key")
    u2 = hash_uniform_sql(SEED_TARGET2, "key")
    return f"""
    li0 AS (
      SELECT {row_key_sql()} AS key, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
    ),
    li1 AS (
      SELECT *, 0.02::DOUBLE * l_quantity
               + CASE WHEN l_discount > 0.05 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
               + 0.1::DOUBLE * ({u} - 0.5::DOUBLE) AS reg,
             {u2} AS u2
      FROM li0
    ),
    li AS (
      SELECT key, l_quantity, l_extendedprice, l_discount, l_tax, reg, exp(reg) AS reg_positive,
             CASE WHEN reg + 0.5::DOUBLE * (u2 - 0.5::DOUBLE) > 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cls,
             CASE WHEN {hash_uniform_sql(SEED_TEST, 'key')} < {TEST_FRACTION} THEN 'test'
                  WHEN {hash_uniform_sql(SEED_VAL, 'key')} < {VAL_FRACTION} THEN 'val'
                  ELSE 'train' END AS split
      FROM li1
    )"""


EVENT_SEED = 7


def events_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with features (value, hour of ts) and the planted label ``events_cls``."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "value"])
    hour = F.hour("ts").cast("double")
    base = (F.col("value") > 30) & (F.hour("ts") >= 12)
    flip = hash_below(0.05, EVENT_SEED, F.col("event_id"))
    label = F.when(base != flip, F.lit(1.0)).otherwise(F.lit(0.0))
    split = (
        F.when(hash_below(TEST_FRACTION, SEED_TEST, F.col("event_id")), F.lit("test"))
        .when(hash_below(VAL_FRACTION, SEED_VAL, F.col("event_id")), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return ev.select(
        F.col("event_id").cast("string").alias("key"),
        F.col("value").alias("value"),
        hour.alias("hour"),
        label.alias("label"),
        split.alias("split"),
    )


def events_planted_sql() -> str:
    return f"""
    ev AS (
      SELECT CAST(event_id AS VARCHAR) AS key, value, CAST(hour(ts) AS DOUBLE) AS hour,
             CASE WHEN ((value > 30 AND hour(ts) >= 12) <> ({hash_uniform_sql(EVENT_SEED, 'event_id')} < 0.05))
                  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
             CASE WHEN {hash_uniform_sql(SEED_TEST, 'event_id')} < {TEST_FRACTION} THEN 'test'
                  WHEN {hash_uniform_sql(SEED_VAL, 'event_id')} < {VAL_FRACTION} THEN 'val'
                  ELSE 'train' END AS split
      FROM events
    )"""
