"""Data preparation: hold-out splits and min-max scaling, all as distributed aggregates.

No operator here depends on partitioning: splits are decided by a seeded hash of the
row key, so re-running a lost task assigns every row to the same side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneforge.functions.hashing import hash_below
from tuneforge.session import cut_lineage

# level-1 bucket = top 16 bits of the 32-bit row hash; level 2 resolves one bucket exactly
_LEVEL1_SHIFT = 16
_BROADCAST_ROW_LIMIT = 2_000_000  # side tables are broadcast only below this measured row count


def _hash32(seed, key: str) -> Column:
    key_str = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(key_str), 1, 8), 16, 10).cast("long")


def train_test_split(
    df: DataFrame,
    test_size: float,
    seed: int,
    key: str = "key",
    out_col: str = "split",
    picked: str = "test",
    rest: str = "train",
    eligible: Column | None = None,
) -> DataFrame:
    """Random hold-out: a row goes to ``picked`` iff ``u(seed, key) < test_size``.

    ``eligible`` restricts the split to a subset (e.g. non-test rows for a second split);
    other rows keep their current ``out_col`` value.
    """
    decision = F.when(hash_below(test_size, seed, F.col(key)), F.lit(picked)).otherwise(F.lit(rest))
    if eligible is not None:
        decision = F.when(eligible, decision).otherwise(F.col(out_col))
    return df.withColumn(out_col, decision)


def _checked_side(df: DataFrame) -> DataFrame:
    """Checkpoint a side table and broadcast it only if its measured size is bounded."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= _BROADCAST_ROW_LIMIT else df


def stratified_split(
    df: DataFrame,
    label: str,
    test_size: float,
    seed: int,
    key: str = "key",
    out_col: str = "split",
    picked: str = "test",
    rest: str = "train",
    eligible: Column | None = None,
) -> DataFrame:
    """Exact per-class quota hold-out.

    Within each class rows are ranked by ``(hash32(seed, key), key)`` and the first
    ``round(test_size * class_size)`` go to ``picked``. The rank is never computed by a
    window over a whole class: counts per (class, hash bucket) give each bucket its offset,
    only the one bucket straddling the quota is counted per exact hash value, and keys are
    gathered and ordered for the one hash value of each class that straddles the quota. Side
    tables are counts, bounded by classes x 65,536 rows; the big side never shuffles (it is written
    once with its hashes and scanned four times). Keys must be unique.
    """
    d = df.withColumn("_h", _hash32(seed, key)).withColumn("_b", F.shiftright(F.col("_h"), _LEVEL1_SHIFT))
    d = d.withColumn("_e", F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)))
    d = cut_lineage(d)  # the rows are made and hashed once, not by each of the four scans
    elig = d.filter(F.col("_e"))

    # level 1: bucket counts -> offset before each bucket and class quota
    c1 = elig.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c1"))
    wl = Window.partitionBy(label)
    c1 = (
        c1.withColumn("_before1", F.coalesce(F.sum("_c1").over(wl.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_quota", F.round(F.lit(float(test_size)) * F.sum("_c1").over(wl)).cast("long"))
    )
    # side table computed once (not re-derived by every branch), broadcast under a size check
    d = d.join(_checked_side(c1), [label, "_b"], "left")
    s1 = (
        F.when(~F.col("_e"), F.lit(0))
        .when(F.col("_before1") + F.col("_c1") <= F.col("_quota"), F.lit(1))
        .when(F.col("_before1") >= F.col("_quota"), F.lit(0))
        .otherwise(F.lit(-1))
    )
    d = d.withColumn("_s", s1)

    # level 2: exact hash values inside the straddling bucket, counts only
    c2 = (
        d.filter((F.col("_s") == -1) & F.col("_e"))
        .groupBy(label, "_h")
        .agg(F.count(F.lit(1)).alias("_c2"), F.first("_before1").alias("_b1"))
    )
    c2 = c2.withColumn(
        "_before2",
        F.col("_b1") + F.coalesce(F.sum("_c2").over(wl.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select(label, "_h", "_c2", "_before2")
    d = d.join(_checked_side(c2), [label, "_h"], "left")
    s2 = (
        F.when(F.col("_s") != -1, F.col("_s"))
        .when(~F.col("_e"), F.lit(0))
        .when(F.col("_before2") + F.col("_c2") <= F.col("_quota"), F.lit(1))
        .when(F.col("_before2") >= F.col("_quota"), F.lit(0))
        .otherwise(F.lit(-1))
    )
    d = d.withColumn("_s2", s2)

    # level 3: the rows of one hash value for each class, ranked by key
    c3 = d.filter((F.col("_s2") == -1) & F.col("_e")).groupBy(label).agg(F.sort_array(F.collect_list(F.col(key))).alias("_keys"))
    d = d.join(_checked_side(c3), label, "left")
    s2 = F.when(F.col("_s2") != -1, F.col("_s2")).when(
        F.col("_before2") + F.array_position(F.col("_keys"), F.col(key)) <= F.col("_quota"), F.lit(1)).otherwise(F.lit(0))
    decision = F.when(s2 == 1, F.lit(picked)).otherwise(F.lit(rest))
    if eligible is not None:
        decision = F.when(F.col("_e"), decision).otherwise(F.col(out_col))
    out = d.withColumn(out_col, decision)
    return out.drop("_e", "_h", "_b", "_c1", "_before1", "_quota", "_s", "_c2", "_before2", "_s2", "_keys")


def min_max_fit(df: DataFrame, cols: list[str], fit_filter: Column | None = None) -> dict[str, tuple[float, float]]:
    """Column minima and maxima over the fitting rows: one distributed aggregate, one small row back."""
    src = df if fit_filter is None else df.filter(fit_filter)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}")]
    row = src.agg(*aggs).first()
    return {c: (row[f"mn_{c}"], row[f"mx_{c}"]) for c in cols}


def min_max_apply(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """``(x - min) / range`` with range 1 for a constant column (so its fitted value scales to 0); no clipping."""
    out = df
    for c, (mn, mx) in stats.items():
        rng = (mx - mn) if (mx is not None and mn is not None and mx > mn) else 1.0
        out = out.withColumn(c + suffix, (F.col(c) - F.lit(float(mn))) / F.lit(float(rng)))
    return out


def min_max_scale(df: DataFrame, cols: list[str], fit_filter: Column | None = None, suffix: str = "") -> DataFrame:
    """Fit min-max on ``fit_filter`` rows and apply to all rows (scikit-learn MinMaxScaler semantics)."""
    return min_max_apply(df, min_max_fit(df, cols, fit_filter), suffix)


def scale_target(df: DataFrame, label: str, fit_filter: Column | None = None, suffix: str = "") -> DataFrame:
    """Min-max scaling of the target column, fitted on the training rows."""
    return min_max_scale(df, [label], fit_filter, suffix)
