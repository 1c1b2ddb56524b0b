"""Model operators: MLP gradients and partition equivalence, swarm invariants, registry."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneforge.operators import mlp
from tuneforge.operators import swarm as sw
from tuneforge.operators.space import SearchSpace


@pytest.mark.parametrize("a1,a2,loss", [("tanh", "sigmoid", "binary_crossentropy"), ("relu", "sigmoid", "mse"), ("sigmoid", "tanh", "mse")])
def test_mlp_gradient_finite_difference(a1, a2, loss):
    rng = np.random.default_rng(0)
    d, h = 3, 5
    X = rng.normal(size=(7, d))
    y = (rng.random(7) > 0.5).astype(float) * (0.8 if loss == "mse" else 1.0)
    w = rng.normal(scale=0.5, size=mlp.param_size(d, h))
    g = mlp.gradient(w, X, y, d, h, a1, a2, loss)

    def f(v):
        return mlp.loss_value(loss, y, mlp.forward(v, X, d, h, a1, a2)[3]).mean()

    num = np.array([(f(w + e) - f(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6])
    assert np.allclose(g, num, atol=1e-5)


def test_mlp_one_partition_equals_sequential(spark):
    rng = np.random.default_rng(1)
    n, d = 60, 2
    X = rng.random((n, d))
    y = (X[:, 0] > 0.5).astype(float)
    rows = [(f"r{i}", [float(v) for v in X[i]], float(y[i]), "train") for i in range(n)]
    df = spark.createDataFrame(rows, "key string, features array<double>, label double, split string")
    c = {"trial_id": 0, "neurons": 4, "hiddenactivation": "tanh", "activation": "sigmoid", "loss": "binary_crossentropy",
         "optimizer": "adam", "learning_rate": 0.05, "batch_size": 12, "epochs": 2}
    weights, _, _ = mlp.fit_mlp(df, [c], d, seed=3, epochs=2, patience=None, n_shards=1)
    # sequential reference with the same order and initialisation
    w = mlp.init_params(0, d, 4, 3)
    slots, t = [np.zeros_like(w), np.zeros_like(w)], 0
    keys = np.array([r[0] for r in rows])
    for e in range(2):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"3:{e}:{keys[i]}".encode()).hexdigest()[:8], keys[i]))
        Xo, yo = X[order], y[order]
        for s in range(0, n, 12):
            t += 1
            w, slots = mlp.step("adam", 0.05, w, slots, t, mlp.gradient(w, Xo[s:s + 12], yo[s:s + 12], d, 4, "tanh", "sigmoid", "binary_crossentropy"))
    assert np.allclose(weights[0], w, atol=1e-12)


def test_mlp_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    X = rng.random((400, 2))
    rows = [(f"r{i}", [float(v) for v in X[i]], float(X[i, 0] > X[i, 1]), "val" if i % 5 == 0 else "train") for i in range(400)]
    df = spark.createDataFrame(rows, "key string, features array<double>, label double, split string")
    cands = [{"trial_id": k, "neurons": 4, "hiddenactivation": "relu", "activation": "sigmoid", "loss": "binary_crossentropy",
              "optimizer": o, "learning_rate": 0.05, "batch_size": 16, "epochs": 4} for k, o in enumerate(["adam", "sgd", "RMSprop"])]
    found = [mlp.fit_mlp(d, cands, 2, seed=1, epochs=4) for d in (df.coalesce(1), df.repartition(2, "key"), df.repartition(13, "label"))]
    for weights, history, _ in found[1:]:
        assert all(np.allclose(weights[k], found[0][0][k], atol=1e-10) for k in weights)
        assert [h[:2] for h in history] == [h[:2] for h in found[0][1]] and np.allclose([h[2:] for h in history], [h[2:] for h in found[0][1]])
    losses = [h[2] for h in found[0][1] if h[0] == 0]
    assert len(losses) == 4 and losses[-1] < losses[0]


def test_swarm_stays_in_bounds_and_best_is_monotone(spark):
    space = SearchSpace.from_dict({"a": [0, 1, 3], "b": [-2, 2, 3]})

    def fitness(cands):
        # sphere objective as a column expression over the candidate table
        return cands.select("trial_id", (F.col("params.a") ** 2 + F.col("params.b") ** 2).alias("cost"))

    from tuneforge.plans.search import search_pso

    res = search_pso(spark, space, fitness, n_particles=6, iterations=5, seed=2, options={"w": 1.5, "c1": 2.0, "c2": 2.0})
    rows = res.trials.collect()
    for r in rows:
        assert 0 <= r["x"][0] <= 1 and -2 <= r["x"][1] <= 2
    best = [r["best_cost"] for r in sorted(res.history.collect(), key=lambda r: r["iteration"])]
    assert all(b2 <= b1 for b1, b2 in zip(best, best[1:]))


def test_register_estimator(spark):
    from tuneforge.plans.facade import HyperSearch
    from tuneforge.plans.registry import register_estimator

    def fit_batch(spark_, data, cands, task, score, options=None):
        # cost = |c - mean(label of train rows)|, one aggregate for the whole batch
        m = data.rows.filter(F.col("split") == "train").agg(F.avg("label")).first()[0]
        return spark_.createDataFrame([(c["trial_id"], abs(c["c"] - m), "ok", None) for c in cands],
                                      "trial_id bigint, cost double, status string, error string")

    register_estimator("constant", lambda task: {"c": [0, 2, 1]}, lambda task: {}, fit_batch)
    hs = HyperSearch(spark, "constant", None, "regression", "rmse")
    df = spark.createDataFrame([(f"k{i}", [float(i)], 1.0, "train") for i in range(10)],
                               "key string, f array<double>, label double, split string").selectExpr("key", "f[0] AS x", "label", "split")
    data = hs.prepare(df, ["x"], "label")
    res = hs.fit_grid(data)
    best = hs.best(res).first()
    assert best["c"] == 1.0 and best["cost"] == 0.0


def test_validation_errors(spark):
    from tuneforge.plans.facade import HyperSearch

    with pytest.raises(ValueError):
        HyperSearch(spark, "nope", None, "regression", "rmse")
    with pytest.raises(ValueError):
        HyperSearch(spark, "xgboost", None, "regression", "acc")


def test_facade_summary_and_save(spark):
    from tuneforge.plans.facade import HyperSearch
    from tuneforge.plans.registry import register_estimator

    def fit_batch(spark_, data, cands, task, score, options=None):
        return spark_.createDataFrame([(c["trial_id"], (c["c"] - 0.7) ** 2, "ok", None) for c in cands],
                                      "trial_id bigint, cost double, status string, error string")

    register_estimator("quadratic", lambda task: {"c": [0, 2, 1]}, lambda task: {}, fit_batch)
    hs = HyperSearch(spark, "quadratic", None, "regression", "rmse")
    df = spark.createDataFrame([(f"k{i}", float(i), 1.0, "train") for i in range(5)], "key string, x double, label double, split string")
    data = hs.prepare(df, ["x"], "label")
    grid = hs.fit_grid(data)
    row = hs.summary(grid).first()
    assert row["c"] == 0.7 and row["best_cost"] == 0.0 and row["selection_type"] == "Grid"
    pso = hs.fit_pso(data, n_particles=4, n_iterations=3, seed=1)
    for res in (grid, pso):
        folder, saved = hs.save(res)
        best_trial = min(r["cost"] for r in spark.read.parquet(f"{folder}/trials").collect())
        assert saved.first()["best_cost"] == round(best_trial, 4)
        assert spark.read.parquet(f"{folder}/trials").count() == res.attempts


def test_long_elite_swarm_does_not_compound(spark):
    """Ten iterations with elite retention (self-joins every iteration) stay flat in cost."""
    import time

    from tuneforge.plans.search import search_pso

    space = SearchSpace.from_dict({"a": [0, 3, 0], "b": [0, 10, 0]})
    calls = [0]

    def fitness(c):
        calls[0] += 1
        return c.select("trial_id", (F.col("params.a") + F.col("params.b") + F.lit(calls[0] % 3)).cast("double").alias("cost"))

    t = time.time()
    res = search_pso(spark, space, fitness, n_particles=4, iterations=10, seed=1, elite=True)
    assert res.trials.count() == 40
    assert time.time() - t < 300
    # an elite refit never reports more than the elite cost known before it
    rows = sorted(res.trials.collect(), key=lambda r: (r["iteration"], r["pid"]))
    assert all(r["cost"] <= r["raw_cost"] for r in rows if r["raw_cost"] is not None)


def _small(spark, task):
    rng = np.random.default_rng(6)
    X = rng.random((240, 2))
    y = X[:, 0] + 0.3 * X[:, 1] if task == "regression" else (X[:, 0] + 0.3 * rng.random(240) > 0.6).astype(float)
    rows = [(f"k{i}", float(X[i, 0]), float(X[i, 1]), float(y[i]), ("val", "test", "train", "train")[i % 4]) for i in range(240)]
    return spark.createDataFrame(rows, "key string, a double, b double, label double, split string")


@pytest.mark.parametrize("estimator,task,score,space,options", [
    ("xgboost", "regression", "rmse", {"learning_rate": [0.2, 0.6, 1], "max_depth": [1, 3, 0], "n_estimators": [2, 4, 0]}, {"n_bins": 8}),
    ("gbdt", "binary classification", "auc", {"learning_rate": [0.2, 0.6, 1], "max_depth": [1, 2, 0], "n_estimators": [4, 6, 0]}, {"n_bins": 8, "early_stopping_rounds": 1}),
    ("svm", "binary classification", "acc", {"kernel": ["rbf"], "gamma": [1, 5, 0], "C": [1, 10, 0]}, {"n_steps": 3, "n_components": 8}),
    ("mlp", "binary classification", "auc", None, {"epochs": 2}),
])
def test_the_winners_model_gives_the_trials_cost(spark, tmp_path, estimator, task, score, space, options):
    from tuneforge.plans.facade import HyperSearch
    from tuneforge.plans.model import FittedModel

    hs = HyperSearch(spark, estimator, space, task, score, options=options)
    data = hs.prepare(_small(spark, task), ["a", "b"], "label")
    res = hs.fit_random(data, n_attempts=3, seed=2)
    assert {r["status"] for r in res.trials.collect()} == {"ok"}
    model = hs.best_model(data, res)
    assert model.score_holdout(data.rows, score, "val") == pytest.approx(hs.best(res).first()["cost"], abs=1e-8)
    model.save(spark, str(tmp_path / "m"))
    again = FittedModel.load(spark, str(tmp_path / "m"))
    test = data.rows.filter("split = 'test'")
    assert sorted(again.predict(test).collect()) == sorted(model.predict(test).collect()) and again.predict(test).count() == 60


def test_a_fit_that_raises_fails_its_own_trial(spark):
    from tuneforge.plans.facade import HyperSearch
    from tuneforge.plans.registry import register_estimator

    def fit_batch(spark_, data, cands, task, score, options=None):
        if any(c["c"] > 1.5 for c in cands):
            raise RuntimeError("no fit above 1.5")
        return spark_.createDataFrame([(c["trial_id"], float(c["c"]), "ok", None) for c in cands], "trial_id bigint, cost double, status string, error string")

    register_estimator("touchy", lambda task: {"c": [0, 2, 0]}, lambda task: {}, fit_batch)
    hs = HyperSearch(spark, "touchy", None, "regression", "rmse")
    res = hs.fit_grid(hs.prepare(_small(spark, "regression"), ["a", "b"], "label"), chunk=2)
    got = {r["c"]: (r["cost"], r["status"], r["error"]) for r in res.trials.collect()}
    assert got == {0: (0.0, "ok", None), 1: (1.0, "ok", None), 2: (None, "failed", "no fit above 1.5")}


def test_platt_scaling_does_not_see_the_scored_labels(spark):
    """Validation labels turned round: the AUC of an honest probability stays below one half."""
    from tuneforge.plans.facade import HyperSearch

    df = _small(spark, "binary classification")
    turned = df.withColumn("label", F.when(F.col("split") == "val", 1.0 - F.col("label")).otherwise(F.col("label")))
    hs = HyperSearch(spark, "svm", {"kernel": ["linear"], "gamma": [1, 2, 0], "C": [5, 6, 0]}, "binary classification", "auc", options={"n_steps": 10})
    res = hs.fit_grid(hs.prepare(turned, ["a", "b"], "label"))
    assert all(r["cost"] > 0.5 for r in res.trials.collect())


def test_mlp_epoch_of_several_shards_equals_plain_averaging(spark):
    """One epoch over three shards: the row-weighted mean of plain runs, and the losses of the history."""
    rng = np.random.default_rng(6)
    n, d = 150, 2
    X = rng.random((n, d))
    y = (X[:, 0] > X[:, 1]).astype(float)
    split = np.where(np.arange(n) % 5 == 0, "val", "train")
    df = spark.createDataFrame([(f"r{i}", X[i].tolist(), float(y[i]), str(split[i])) for i in range(n)], "key string, features array<double>, label double, split string")
    c = {"trial_id": 3, "neurons": 5, "hiddenactivation": "sigmoid", "activation": "sigmoid", "loss": "binary_crossentropy", "optimizer": "nadam", "learning_rate": 0.05, "batch_size": 8}
    weights, history, _ = mlp.fit_mlp(df, [c], d, seed=9, epochs=1, n_shards=3)
    shard = {r.key: r.s for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(3)).alias("s")).collect()}
    w0, total, loss, rows = mlp.init_params(3, d, 5, 9), 0.0, 0.0, 0
    for s in range(3):
        order = sorted((i for i in range(n) if split[i] == "train" and shard[f"r{i}"] == s), key=lambda i: (hashlib.md5(f"9:0:r{i}".encode()).hexdigest()[:8], f"r{i}"))
        w, slots, t = w0, [np.zeros_like(w0), np.zeros_like(w0)], 0
        for k in range(0, len(order), 8):
            some = order[k : k + 8]
            t += 1
            part, g = mlp.loss_and_gradient(w, X[some], y[some], d, 5, "sigmoid", "sigmoid", "binary_crossentropy")
            w, slots = mlp.step("nadam", 0.05, w, slots, t, g)
            loss += part
        total, rows = total + len(order) * w, rows + len(order)
    assert np.allclose(weights[3], total / rows, atol=1e-12)
    val = split == "val"
    out = mlp.forward(weights[3], X[val], d, 5, "sigmoid", "sigmoid")[3]
    assert history == [(3, 0, pytest.approx(loss / rows), pytest.approx(float(mlp.loss_value("binary_crossentropy", y[val], out).mean())))]


def test_mlp_tasks_grow_with_rows(spark):
    df = spark.range(40_000).select(F.col("id").cast("string").alias("key"), F.array(F.rand(1), F.rand(2)).alias("features"), (F.rand(3) > 0.5).cast("double").alias("label"), F.lit("train").alias("split"))
    src = mlp._packed_shards(df, round(40_000 / mlp.SHARD_ROWS))
    assert src.rdd.getNumPartitions() == 5 and src.count() == 5


@pytest.mark.parametrize("shape", ["spread", "clusters", "one place"])
def test_local_best_of_a_large_swarm(spark, shape):
    """Neighbours by cells are those of all distances, whatever the density of the swarm."""
    rng = np.random.default_rng(8)
    n, k = 10_000, 3
    x = rng.random((n, 3)) * 10
    if shape == "clusters":
        x = np.round(np.concatenate([rng.normal(c, 0.01, (n // 4, 3)) for c in (1, 1.5, 8, 9)]), 2)  # many meet in one place
    if shape == "one place":
        x[50:] = 4.0
    cost = np.where(rng.random(n) < 0.1, np.nan, rng.random(n))
    rows = [(i, 0, x[i].tolist(), [0.0] * 3, None, [float(i)] * 3, None if np.isnan(cost[i]) else float(cost[i]), None, None, None, None) for i in range(n)]
    schema = "pid long, sid int, x array<double>, v array<double>, cost double, pbest_x array<double>, pbest_cost double, nbest_x array<double>, nbest_cost double, gbest_x array<double>, gbest_cost double"
    found = {r.pid: r for r in sw.local_best(spark.createDataFrame(rows, schema), k).collect()}
    assert len(found) == n
    for i in range(0, n, 37):
        d = ((x - x[i]) ** 2).sum(1)
        near = np.lexsort((np.arange(n), d))[:k]
        known = [(cost[j], j) for j in near if not np.isnan(cost[j])]
        assert found[i].nbest_cost == (min(known)[0] if known else None)
        assert found[i].nbest_x == ([float(min(known)[1])] * 3 if known else None)
