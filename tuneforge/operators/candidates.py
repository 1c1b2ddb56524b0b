"""Candidate tables: grid enumeration, random candidates, decoding and de-duplication.

A candidate is a row ``(trial_id, pos ARRAY<DOUBLE>)``; decoding adds ``params`` (a struct
with one typed field per parameter, defaults merged underneath). The grid is never
materialised on the driver: it is ``spark.range(total)`` decoded in mixed radix with the
last dimension as the least-significant digit (itertools.product order).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.functions.hashing import hash_uniform
from tuneforge.operators.space import SearchSpace

_TWO_POW_32 = 2 ** 32


def _strides(space: SearchSpace) -> list[int]:
    cards = space.cardinalities
    return [math.prod(cards[j + 1:]) for j in range(len(cards))]


def index_to_position(space: SearchSpace, index_col: str) -> Column:
    """Grid point (encoded position array) of a 0-based grid index column, mixed radix."""
    values = []
    for dim, stride, card in zip(space.dims, _strides(space), space.cardinalities):
        digit = F.pmod(_idiv(index_col, stride), F.lit(card)).cast("long")
        if dim.is_categorical:
            values.append(digit.cast("double"))
        else:
            raw = F.lit(dim.lo) + digit.cast("double") * F.lit(dim.step)
            values.append(F.bround(raw, dim.decimals))
    return F.array(*values)


def _idiv(index_col: str, stride: int) -> Column:
    """Integral division of a bigint index (SQL ``div``), exact for any size."""
    col = F.col(index_col).cast("long")
    return col if stride == 1 else F.expr(f"CAST(`{index_col}` AS BIGINT) div {int(stride)}")


def grid_enumerate(spark: SparkSession, space: SearchSpace, num_partitions: int | None = None) -> DataFrame:
    """All grid combinations as ``(trial_id, pos)``; the count is ``space.total`` (arithmetic)."""
    total = space.total
    if num_partitions is None:
        num_partitions = max(1, min(4096, total // 250_000 + 1))
    ids = spark.range(0, total, 1, num_partitions)
    return ids.select(F.col("id").alias("trial_id"), index_to_position(space, "id").alias("pos"))


def random_index(space: SearchSpace, seed: int, id_col: Column) -> Column:
    """Uniform grid index in ``[0, total)`` from a seeded hash of the attempt id (with replacement)."""
    total = space.total
    u = hash_uniform(seed, id_col)
    if total > _TWO_POW_32:
        # 64 hash bits so every index of a huge grid is reachable
        u = u + hash_uniform(seed + 1_000_003, id_col) / F.lit(float(_TWO_POW_32))
    return F.least(F.floor(u * F.lit(float(total))).cast("long"), F.lit(total - 1))


def random_candidates(
    spark: SparkSession,
    space: SearchSpace,
    seed: int,
    n: int | None = None,
    ids: DataFrame | None = None,
    id_col: str = "trial_id",
) -> DataFrame:
    """``n`` attempts (or one per row of ``ids``) drawn uniformly over the grid, with replacement."""
    if ids is None:
        if n is None:
            raise ValueError("give n or ids")
        ids = spark.range(n).withColumnRenamed("id", id_col)
    idx = random_index(space, seed, F.col(id_col))
    return ids.select(F.col(id_col).alias("trial_id"), idx.alias("grid_index")).select(
        "trial_id", "grid_index", index_to_position(space, "grid_index").alias("pos")
    )


def _literal(value) -> Column:
    if isinstance(value, bool):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("bigint")
    if isinstance(value, float):
        return F.lit(value).cast("double")
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(str(v)) for v in value]).cast("array<string>")
    return F.lit(str(value))


def decode_columns(space: SearchSpace, pos: Column) -> list[Column]:
    """Decoded parameter columns: categorical ``categories[bround(x)]`` (half-even),
    numeric ``bround(x, decimals)``, cast to BIGINT when decimals = 0."""
    cols = []
    for j, dim in enumerate(space.dims):
        x = F.element_at(pos, j + 1)
        if dim.is_categorical:
            cats = F.array(*[F.lit(c) for c in dim.categories])
            idx = F.bround(x, 0).cast("int") + F.lit(1)
            cols.append(F.when((idx >= 1) & (idx <= len(dim.categories)), F.element_at(cats, idx)).alias(dim.name))
        else:
            v = F.bround(x, dim.decimals)
            cols.append((v.cast("bigint") if dim.decimals == 0 else v).alias(dim.name))
    return cols


def params_struct(space: SearchSpace, pos: Column, with_defaults: bool = True) -> Column:
    """``{**defaults, **decoded}`` as a struct; decoded fields win."""
    fields = decode_columns(space, pos)
    if with_defaults:
        decoded_names = set(space.names)
        for name, value in space.defaults.items():
            if name not in decoded_names:
                fields.append(_literal(value).alias(name))
    return F.struct(*fields)


def decode_candidates(df: DataFrame, space: SearchSpace, pos_col: str = "pos", with_defaults: bool = True) -> DataFrame:
    return df.withColumn("params", params_struct(space, F.col(pos_col), with_defaults))


def dedupe_candidates(decoded: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """One row per distinct decoded parameter set: ``(params, trial_id = first id, n_positions)``.

    Fit this table, then join costs back on ``params`` so identical decoded points are
    fitted once. Aggregates partially before the shuffle, so a hot parameter set costs
    one row per partition.
    """
    keys = key_cols or ["params"]
    return decoded.groupBy(*keys).agg(
        F.min("trial_id").alias("trial_id"), F.count(F.lit(1)).alias("n_positions")
    )
