"""Exact AUC / ROC against brute-force pair counting on small fixtures with ties."""

import itertools
import random

import pytest

from tuneforge.operators import scoring


def brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_matches_pair_counting(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for t in range(3):
        for i in range(400):
            y = 1 if rnd.random() < 0.4 else 0
            s = round(rnd.random() * 0.6 + 0.4 * y, 1 if t == 0 else 3)   # heavy ties for t = 0
            rows.append((t, float(y), s))
    df = spark.createDataFrame(rows, "trial_id long, label double, score double")
    got = {r["trial_id"]: r["auc"] for r in scoring.auc_value(df, ["trial_id"]).collect()}
    for t in range(3):
        lab = [r[1] for r in rows if r[0] == t]
        sc = [r[2] for r in rows if r[0] == t]
        assert got[t] == pytest.approx(brute_auc(lab, sc), abs=1e-12)


def test_auc_golden_fraction(spark):
    # 36 positives x 21 negatives with exactly 10 discordant pairs -> 746/756
    rows = [(0, 1.0, 0.9)] * 26 + [(0, 1.0, 0.1)] * 10 + [(0, 0.0, 0.2)] * 1 + [(0, 0.0, 0.05)] * 20
    df = spark.createDataFrame(rows, "trial_id long, label double, score double")
    auc = scoring.auc_value(df, ["trial_id"]).first()["auc"]
    assert auc == pytest.approx(746 / 756, abs=1e-15)


def test_roc_endpoints(spark):
    rows = [(0, 1.0, 0.8), (0, 0.0, 0.3), (0, 1.0, 0.3), (0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "trial_id long, label double, score double")
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in scoring.roc_curve(df, ["trial_id"]).collect()}
    assert roc[0.8] == (0.0, 0.5)
    assert roc[0.3] == (0.5, 1.0)
    assert roc[0.1] == (1.0, 1.0)


def test_auc_of_many_distinct_scores(spark):
    """Two million distinct scores of two trials, against the rank sum by numpy."""
    import numpy as np
    from pyspark.sql import functions as F

    n = 1_000_000
    df = spark.range(n).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("trial_id"), "id")
    df = df.select("trial_id", ((F.col("id") * 7919) % 1_000_003).alias("s"), ((F.col("id") * 31 + F.col("trial_id")) % 3 == 0).cast("double").alias("label"))
    got = {r["trial_id"]: r["auc"] for r in scoring.auc_value(df.withColumn("score", F.col("s") / 1e7), ["trial_id"]).collect()}
    ids = np.arange(n)
    for t in (0, 1):
        order = np.argsort(ids * 7919 % 1_000_003)
        y = ((ids * 31 + t) % 3 == 0)[order]
        P, N = int(y.sum()), int((~y).sum())
        assert abs(got[t] - float((np.cumsum(~y)[y]).sum()) / (P * N)) < 1e-12
