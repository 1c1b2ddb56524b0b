"""Deeper, heterogeneous booster batches against the SQL re-derivation (histogram subtraction
below the root must not change any split or leaf)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tools.check_oracle import duck_con
from tuneforge.operators import trees
from tuneforge.plans import catalog, oracle


@pytest.mark.parametrize("kind,label", [("reg:linear", "reg"), ("reg:gamma", "reg_positive")])
def test_deep_mixed_batch_matches_sql(spark, kind, label):
    """Histograms below the root are half aggregated, half subtracted."""
    binned, b = catalog.tree_rows(spark, SF_SMALL, label)
    cands = [
        {"trial_id": 0, "objective": kind, "learning_rate": 0.3, "max_depth": 4, "n_estimators": 2, "subsample": 0.8},
        {"trial_id": 1, "objective": kind, "learning_rate": 0.5, "max_depth": 2, "n_estimators": 3, "subsample": 1.0},
    ]
    cfg = trees.BoostConfig(seed=13, binning="uniform", n_bins=16)
    res = trees.fit_boosted_trees(spark, binned, cands, "rmse", cfg, b)
    got = {r.trial_id: round(r.cost, 6) for r in res.costs.collect()}
    ctes, _ = oracle.boost_sql_cands(cands, label, "rmse", seed=13)
    last = " UNION ALL ".join(f"SELECT trial_id, val_cost FROM vc{t} WHERE trial_id IN "
                              f"(SELECT trial_id FROM cand WHERE nest = {t + 1})" for t in range(3))
    rows = duck_con(SF_SMALL).sql(f"WITH {oracle.LI}, {', '.join(ctes)} {last}").fetchall()
    assert got == {t: round(v, 6) for t, v in rows}


def test_invalid_candidates_fail_cleanly(spark):
    binned, b = catalog.tree_rows(spark, SF_SMALL, "reg")
    cands = [
        {"trial_id": 0, "objective": "reg:gamma", "learning_rate": 0.3, "max_depth": 2, "n_estimators": 1, "subsample": 1.0},
        {"trial_id": 1, "objective": "no-such", "learning_rate": 0.3, "max_depth": 2, "n_estimators": 1, "subsample": 1.0},
        {"trial_id": 2, "objective": "reg:linear", "learning_rate": 0.3, "max_depth": 2, "n_estimators": 1, "subsample": 1.0},
    ]
    res = trees.fit_boosted_trees(spark, binned, cands, "rmse", trees.BoostConfig(binning="uniform"), b)
    st = {r.trial_id: (r.status, r.cost) for r in res.costs.collect()}
    assert st[0][0] == "failed" and st[0][1] is None      # reg has non-positive targets
    assert st[1][0] == "failed"
    assert st[2][0] == "ok" and st[2][1] > 0


def test_model_of_an_early_stop_predicts_the_reported_cost(spark):
    """Where the stop fires, the model table ends at the best round: its RMSE is the reported cost."""
    binned, b = catalog.tree_rows(spark, SF_SMALL, "reg")
    cands = [{"trial_id": k, "objective": "reg:linear", "learning_rate": lr, "max_depth": 4, "n_estimators": 8, "subsample": 1.0} for k, lr in enumerate([1.9, 1.0, 0.3])]
    res = trees.fit_boosted_trees(spark, binned, cands, "rmse", trees.BoostConfig(seed=13, binning="uniform", n_bins=16, early_stopping_rounds=2), b)
    pred = trees.predict_boosted(binned.filter("split = 'val'"), res.model, res.cands)
    got = {r.trial_id: r.c for r in pred.groupBy("trial_id").agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("score"), 2))).alias("c")).collect()}
    want = {r.trial_id: r for r in res.costs.collect()}
    assert all(abs(got[t] - r.cost) < 1e-9 for t, r in want.items())
    assert any(r.best_round < 7 for r in want.values())
    assert {r.trial_id: r.m for r in res.model.groupBy("trial_id").agg(F.max("round").alias("m")).collect()} == {t: r.best_round for t, r in want.items()}


# ---------------------------------------------------------------- growth, packed forests, quantiles
def _cands(n, **over):
    return [{"trial_id": k, "objective": "reg:linear", "learning_rate": 0.3, "max_depth": 3, "n_estimators": 2, "subsample": 0.9} | {k2: v(k) if callable(v) else v for k2, v in over.items()} for k in range(n)]


def _model(res):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in res.model.collect()), key=repr)


def test_best_first_with_leaves_to_spare_is_level_wise(spark):
    binned, b = catalog.tree_rows(spark, SF_SMALL, "reg")
    runs = [trees.fit_boosted_trees(spark, binned, _cands(2), "rmse", trees.BoostConfig(seed=3, max_leaves=n), b) for n in (None, 8)]
    assert _model(runs[0]) == _model(runs[1])


def test_leaf_limit_takes_the_best_gains(spark):
    """Best-first to 5 leaves: every leaf that was split has more gain than every one left."""
    binned, b = catalog.tree_rows(spark, SF_SMALL, "reg")
    res = trees.fit_boosted_trees(spark, binned, _cands(1, max_depth=10, n_estimators=1, subsample=1.0), "rmse", trees.BoostConfig(max_leaves=5), b)
    model = res.model.collect()
    assert sum(r.leaf_value is not None for r in model) == 5 and sum(r.feature is not None for r in model) == 4
    train = np.array([(*r.bins, r.label) for r in binned.filter("split = 'train'").collect()])
    x, g = train[:, :-1].astype(int), train[:, -1].mean() - train[:, -1]

    def best(rows):
        found = (0.0, None)
        for j in range(x.shape[1]):
            for cut in range(catalog.TREE_BINS):
                left = rows & (x[:, j] <= cut)
                right = rows & (x[:, j] > cut)
                if left.sum() >= 1 and right.sum() >= 1:
                    gain = round(g[left].sum() ** 2 / (left.sum() + 1) + g[right].sum() ** 2 / (right.sum() + 1) - g[rows].sum() ** 2 / (rows.sum() + 1), 9)
                    if gain > found[0]:
                        found = (gain, (j, cut))
        return found

    leaves, splits = {(0, 0): np.ones(len(x), bool)}, []
    while len(leaves) < 5:
        (level, node), (gain, (j, cut)) = max(((n, best(r)) for n, r in leaves.items()), key=lambda v: v[1][0])
        rows = leaves.pop((level, node))
        splits.append((level, node, j, cut))
        leaves |= {(level + 1, 2 * node): rows & (x[:, j] <= cut), (level + 1, 2 * node + 1): rows & (x[:, j] > cut)}
    assert sorted((r.level, r.node, r.feature, r.bin) for r in model if r.feature is not None) == sorted(splits)


def test_plan_does_not_grow_with_depth(spark):
    binned, b = catalog.tree_rows(spark, SF_SMALL, "reg")
    sizes = []
    for depth in (2, 10):
        res = trees.fit_boosted_trees(spark, binned, _cands(4, max_depth=depth, n_estimators=1), "rmse", trees.BoostConfig(seed=3), b)
        plan = trees.predict_boosted(binned, res.model, res.cands)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert abs(sizes[0] - sizes[1]) < 200


def test_forest_of_many_trees_equals_a_plain_walk():
    rng = np.random.default_rng(2)
    rows = []
    for trial in range(64):
        for rnd in range(70):
            depth, nodes = 10, {(0, 0)}
            for _ in range(12):  # a random tree of twelve splits at most
                level, node = list(nodes)[rng.integers(0, len(nodes))]
                if level < depth:
                    nodes.discard((level, node))
                    nodes |= {(level + 1, 2 * node), (level + 1, 2 * node + 1)}
                    rows.append((trial, rnd, level, node, int(rng.integers(0, 5)), int(rng.integers(0, 31)), None))
            rows += [(trial, rnd, depth, n << (depth - lv), None, None, float(rng.normal())) for lv, n in nodes]
    names = ["trial_id", "round", "level", "node", "feature", "bin", "leaf_value"]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    forest = trees.Forest.of(rows)
    bins = rng.integers(0, 32, (50, 5))
    by = {}
    for r in rows:
        by.setdefault((r["trial_id"], r["round"]), []).append(r)
    for trial in (0, 31, 63):
        want = np.full(50, 0.25)
        for rnd in range(70):
            splits = {(r["level"], r["node"]): r for r in by[trial, rnd] if r["leaf_value"] is None}
            leaf = {r["node"]: r["leaf_value"] for r in by[trial, rnd] if r["leaf_value"] is not None}
            for i in range(50):
                node = 0
                for level in range(10):
                    s = splits.get((level, node))
                    node = 2 * node + (s is not None and bins[i, s["feature"]] > s["bin"])
                want[i] += leaf[node]
        assert np.allclose(forest.raw(bins, trial, 0.25), want)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=777) * 10.0 ** rng.integers(-200, 200, 777), rng.integers(-3, 3, 777).astype(float), np.full(777, -0.0), np.where(rng.random(777) < 0.01, np.inf, rng.random(777))], axis=1)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(5)
    for n_bins in (4, 7, 32):
        found = trees.exact_quantiles(df, 4, n_bins)
        ranks = [-(-777 * i // n_bins) - 1 for i in range(1, n_bins)]
        assert found == [np.sort(x[:, j])[ranks].tolist() for j in range(4)]
    assert trees.exact_quantiles(df.limit(0), 4, 8) == [[]] * 4


def test_patience_of_twenty_fires(spark):
    """gbdt with a learning rate that overshoots: it stops 20 rounds past its best one."""
    binned, b = catalog.tree_rows(spark, SF_SMALL, "reg")
    res = trees.fit_boosted_trees(spark, binned, _cands(1, max_depth=1, n_estimators=70, learning_rate=2.3, subsample=1.0), "rmse", trees.BoostConfig(max_leaves=31, early_stopping_rounds=20), b)
    row, rounds = res.costs.first(), res.history.count()
    assert row.status == "ok" and rounds == row.best_round + 21 < 70
