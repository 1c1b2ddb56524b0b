"""Stratified split: exact per-class quota and rank order, against brute force."""

import hashlib

from pyspark.sql import functions as F

from tuneforge.operators import prep


def h32(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16)


def test_stratified_split_matches_brute_force(spark):
    rows = [(f"k{i}", float(i % 3 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, label double")
    out = {r["key"]: r["split"] for r in prep.stratified_split(df, "label", 0.1, 7).collect()}
    for lab in (0.0, 1.0):
        keys = sorted([k for k, l in rows if l == lab], key=lambda k: (h32(7, k), k))
        q = int(round(0.1 * len(keys) + 1e-12)) if (0.1 * len(keys)) % 1 != 0.5 else int(0.1 * len(keys) + 0.5)
        assert {k for k in keys[:q]} == {k for k in keys if out[k] == "test"}


def test_min_max_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    out = prep.min_max_scale(df, ["x", "c"]).collect()
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]
    assert sorted(r["x"] for r in out) == [0.0, 0.5, 1.0]


def test_second_split_only_touches_eligible_rows(spark):
    df = spark.createDataFrame([(f"k{i}", float(i % 2)) for i in range(2000)], "key string, label double")
    s1 = prep.stratified_split(df, "label", 0.1, 1)
    s2 = prep.stratified_split(s1, "label", 0.15, 2, picked="val", eligible=F.col("split") == "train")
    c = {r["split"]: r["count"] for r in s2.groupBy("split").count().collect()}
    assert c["test"] == 200 and c["val"] == 270 and c["train"] == 1530
