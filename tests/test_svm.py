"""Support vector models: batches of kernels against plain NumPy, TensorSketch, failures, pools."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneforge.operators import kernels, scoring, svm
from tuneforge.plans import failures, search
from tuneforge.plans.facade import HyperSearch
from tuneforge.plans.registry import register_estimator


def plain_steps(z, y, C, steps, lr, kind, seen):
    """Subgradient steps of one model over its own features."""
    z, y = z[seen], y[seen]
    w, b, n = np.zeros(z.shape[1]), 0.0, len(z)
    for t in range(steps):
        eta, f = lr / (1 + t), z @ w + b
        if kind == "svc":
            s = 2 * y - 1
            c = -np.where(s * f < 1, s, 0.0)
        else:
            c = np.where(np.abs(f - y) > 0.1, np.sign(f - y), 0.0)
        w, b = w - eta * (w / (C * n) + z.T @ c / n), b - eta * c.sum() / n
    return w, b


def plain_features(x, cand, m=64, seed=0):
    if cand["kernel"] == "linear":
        return x
    if cand["kernel"] == "rbf":
        omega, phase = svm.rff_params(x.shape[1], m, cand["gamma"], seed)
        return math.sqrt(2 / m) * np.cos(x @ np.array(omega).T + np.array(phase))
    monos = svm.poly_monomials(x.shape[1], cand["degree"])
    return np.stack([c * np.prod(x ** np.array(a), axis=1) for a, c in zip(monos, svm.poly_coefficients(monos, cand["degree"], cand["gamma"]), strict=True)], axis=1)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = ((x[:, 0] - 0.5) ** 2 + (x[:, 1] - 0.5) ** 2 < 0.1).astype(float)
    rows = [(f"r{i}", [float(v) for v in x[i]], float(y[i]), "train" if i % 4 else "val") for i in range(600)]
    df = spark.createDataFrame(rows, "key string, features array<double>, label double, split string").repartition(5).cache()
    return df, x, y


CANDS = [
    {"trial_id": 0, "kernel": "linear", "C": 0.5}, {"trial_id": 1, "kernel": "rbf", "gamma": 0.1, "C": 1.0}, {"trial_id": 2, "kernel": "rbf", "gamma": 7.5, "C": 10.0},
    {"trial_id": 3, "kernel": "rbf", "gamma": 7.5, "C": 0.1}, {"trial_id": 4, "kernel": "poly", "gamma": 2.0, "degree": 3, "C": 1.0}, {"trial_id": 5, "kernel": "poly", "gamma": 0.5, "degree": 0, "C": 1.0},
]


@pytest.mark.parametrize("kind", ["svc", "svr"])
def test_batch_of_all_kernels_equals_plain_fits(table, kind):
    df, x, y = table
    train = df.filter("split = 'train'").select("features", "label", F.pmod(F.regexp_extract("key", r"\d+", 0).cast("int"), F.lit(3)).alias("fold"))
    maps = kernels.FeatureMaps(3)
    fits = kernels.fit_steps(train, kernels.new_fits(CANDS, maps, 3), maps, 6, 0.5, kind)
    assert len(fits) == 4 * len(CANDS)
    at = np.arange(600)
    for f in fits:
        cand = next(c for c in CANDS if c["trial_id"] == f.trial_id)
        w, b = plain_steps(plain_features(x, cand), y, cand["C"], 6, 0.5, kind, (at % 4 > 0) & (at % 3 != f.held_out))
        assert np.allclose(f.w, w, atol=1e-9) and abs(f.b - b) < 1e-9
    scores = {(r.trial_id, r.key): r.score for r in kernels.batch_scores(df, [f for f in fits if f.held_out < 0], maps).collect()}
    assert len(scores) == 600 * len(CANDS)
    f = next(f for f in fits if f.trial_id == 2 and f.held_out < 0)
    want = plain_features(x, CANDS[2]) @ f.w + f.b
    assert all(abs(scores[2, f"r{i}"] - want[i]) < 1e-9 for i in range(600))


def test_platt_steps_equal_long_tables(table):
    df, _, _ = table
    train = df.filter("split = 'train'").select("key", "features", "label", svm.fold_of(3, 17).alias("fold"))
    maps = kernels.FeatureMaps(3)
    cands = [{"trial_id": t, "kernel": "linear", "C": c} for t, c in enumerate([0.1, 1.0, 10.0])]
    fits = kernels.fit_steps(train, kernels.new_fits(cands, maps, 3), maps, 4)
    packed = kernels.platt_steps(train, fits, maps, 4)
    oof = svm.out_of_fold_scores(df, cands, 3, 4, folds=3, seed=17)
    long = svm.platt_scaling(oof.select("trial_id", "label", "score"), 4)
    assert all(np.allclose(packed[t], long[t], rtol=1e-6) for t in long)


def test_jobs_do_not_grow_with_gammas(spark, table):
    df, _, _ = table
    train = df.filter("split = 'train'").select("features", "label", F.lit(0).alias("fold"))

    def jobs(gammas):
        name = f"gammas-{len(gammas)}"
        spark.sparkContext.setJobGroup(name, name)
        maps = kernels.FeatureMaps(3)
        kernels.fit_steps(train, kernels.new_fits([{"trial_id": i, "kernel": "rbf", "gamma": g, "C": 1.0} for i, g in enumerate(gammas)], maps), maps, 2)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs([1.0]) == jobs([0.1 * k for k in range(1, 60)])


def test_many_candidates_over_many_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 200))
    y = (x[:, 0] + x[:, 7] > 0).astype(float)
    df = spark.createDataFrame([(f"r{i}", x[i].tolist(), float(y[i]), "train") for i in range(300)], "key string, features array<double>, label double, split string")
    cands = [{"trial_id": t, "C": 0.1 * (t + 1)} for t in range(64)]
    found = svm.hinge_steps(df, cands, 200, 3)
    for t in (0, 63):
        w, b = plain_steps(x, y, 0.1 * (t + 1), 3, 0.5, "svc", np.ones(300, bool))
        assert np.allclose(found[t][0], w, atol=1e-9) and abs(found[t][1] - b) < 1e-9
    assert svm.decision_scores(df, found, 200).count() == 300 * 64


@pytest.mark.parametrize("degree", [2, 3, 6])
def test_tensor_sketch_error_bound(degree):
    """The mean squared error of kernel values over draws keeps to the bound, and there is no bias."""
    rng = np.random.default_rng(degree)
    x = rng.random((2, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true, size = float(x[0] @ x[1]) ** degree, 512
    errors = []
    for seed in range(40):
        z = kernels.tensor_sketch(x, *kernels.sketch_hashes(30, degree, size, seed), size)
        errors.append(float(z[0] @ z[1]) - true)
    assert np.mean(np.square(errors)) <= (2 + 3 ** degree) / size
    assert abs(np.mean(errors)) <= 4 * np.std(errors) / math.sqrt(len(errors)) + 1e-12


def test_poly_beyond_the_monomial_limit(spark):
    """Degree 6 over 30 features has 1.6 million monomials: the sketch is used, and tells the classes."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 30)) / math.sqrt(30)
    y = (np.abs(x[:, :15]).sum(1) > np.abs(x[:, 15:]).sum(1)).astype(float)
    assert kernels.n_monomials(30, 6) == 1_623_160
    df = spark.createDataFrame([(f"r{i}", x[i].tolist(), float(y[i]), "train" if i < 800 else "val") for i in range(900)], "key string, features array<double>, label double, split string")
    maps = kernels.FeatureMaps(30)
    assert maps.size(("poly", 6, 1.0)) == kernels.SKETCH
    train = df.filter("split = 'train'").select("features", "label", F.lit(0).alias("fold"))
    cand = {"trial_id": 0, "kernel": "poly", "degree": 2, "gamma": 4.0, "C": 10.0}
    small = kernels.FeatureMaps(30, max_monomials=100)  # 465 monomials: sketch and exact map can be compared
    both = [kernels.batch_scores(df, kernels.fit_steps(train, kernels.new_fits([cand], m), m, 10), m).orderBy("key").toPandas()["score"].to_numpy() for m in (maps, small)]
    assert np.corrcoef(both[0], both[1])[0, 1] > 0.8
    fits = kernels.fit_steps(train, kernels.new_fits([cand | {"degree": 6}], maps), maps, 2)
    assert fits[0].w.shape == (kernels.SKETCH,) and np.isfinite(fits[0].w).all()


def test_query_search_equals_plain_derivation(spark):
    """The registered search over rbf: every trial's cost by plain NumPy over the same rows."""
    from tuneforge.plans import catalog

    found = {r.trial_id: r for r in catalog.q_fit_svm_rbf(spark, "/root/testdata/sf0.001").collect()}
    rows = catalog.svm_rows(spark, "/root/testdata/sf0.001").select("features", "label", "split").collect()
    x, y, split = np.array([r.features for r in rows]), np.array([r.label for r in rows], float), np.array([r.split for r in rows])
    for r in list(found.values())[:4]:
        z = plain_features(x, {"kernel": "rbf", "gamma": r.gamma})
        w, b = plain_steps(z, y, r.C, 20, 0.5, "svc", split == "train")
        val = split == "val"
        assert abs(r.cost - np.mean((z[val] @ w + b > 0) != (y[val] == 1))) <= 2.5 / val.sum()  # a value at 0 may fall on either side


# ---------------------------------------------------------------- failures and pools
def _search(spark, fit):
    hs = HyperSearch(spark, "xgboost", {"a": [0, 63, 0]})
    register_estimator("own", lambda task: {"a": [0, 63, 0]}, lambda task: {"a": 1}, fit)
    from tuneforge.plans.registry import get_estimator

    hs._est = get_estimator("own")
    return hs


COSTS = "trial_id bigint, cost double, status string, error string"


def test_bad_candidate_is_found_by_halves(spark):
    calls = []

    def fit(spark, data, cands, task, score, options):
        calls.append(len(cands))
        if any(c["a"] == 41 for c in cands):
            raise failures.ModelError("no fit at 41")
        return spark.createDataFrame([(c["trial_id"], float(c["a"]), "ok", None) for c in cands], COSTS)

    res = _search(spark, fit).fit_grid(None)
    rows = {r.a: r for r in res.trials.collect()}
    assert len(rows) == 64 and rows[41].status == "failed" and "no fit at 41" in rows[41].error
    assert all(r.cost == a for a, r in rows.items() if a != 41)
    assert len(calls) == 1 + 2 * 6  # not one for each candidate


@pytest.mark.parametrize("make, kind", [
    (lambda spark: spark.range(3).select(F.raise_error(F.lit("null feature")).alias("x")).collect(), failures.DATA),
    (lambda spark: spark.range(3).select("missing").collect(), failures.DATA),
    (lambda spark: (_ for _ in ()).throw(OSError("No space left on device")), failures.CLUSTER),
    (lambda spark: (_ for _ in ()).throw(ValueError("bad parameter")), failures.MODEL),
    (lambda spark: np.linalg.inv(np.zeros((2, 2))), failures.MODEL),
])
def test_failure_classes(spark, make, kind):
    with pytest.raises(Exception) as e:  # noqa: PT011
        make(spark)
    assert failures.failure_class(e.value) == kind


def test_errors_inside_tasks(spark):
    def raising(error):
        def run(batches):
            for _ in batches:
                raise error
            yield
        return run
    for error, kind in ((FloatingPointError("overflow in fit"), failures.MODEL), (failures.ModelError("x"), failures.MODEL), (KeyError("column"), failures.DATA)):
        with pytest.raises(Exception) as e:  # noqa: PT011
            spark.range(5).mapInArrow(raising(error), "id long").collect()
        assert failures.failure_class(e.value) == kind, str(e.value)


def test_data_error_ends_the_search(spark):
    def fit(spark, data, cands, task, score, options):
        return spark.range(1).select(F.lit(0).cast("long").alias("trial_id"), F.raise_error(F.lit("feature is null")).cast("double").alias("cost"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))

    with pytest.raises(Exception, match="feature is null"):
        _search(spark, fit).fit_grid(None)


def test_independent_chunks_share_the_cores(spark):
    """Four chunks whose jobs are one slow task each: side by side they take less than in turn."""
    def fitness(cands):
        def wait(batches):
            for b in batches:
                time.sleep(1.5)
                yield b
        return cands.coalesce(1).select("trial_id", F.col("params.a").cast("double").alias("cost")).mapInArrow(wait, "trial_id long, cost double")

    cands = spark.range(8).select(F.col("id").alias("trial_id"), F.struct(F.col("id").alias("a")).alias("params"))
    times, results = [], []
    for n in (1, 4):
        t0 = time.time()
        results.append(sorted(tuple(r) for r in search.evaluate_in_chunks(fitness, cands, 8, 2, in_flight=n).collect()))
        times.append(time.time() - t0)
    assert results[0] == results[1] and len(results[0]) == 8
    assert times[1] < 0.75 * times[0]


def test_accuracy_cost_of_batch_scores(table):
    df, _, y = table
    maps = kernels.FeatureMaps(3)
    train = df.filter("split = 'train'").select("features", "label", F.lit(0).alias("fold"))
    fits = kernels.fit_steps(train, kernels.new_fits(CANDS[2:3], maps), maps, 30)
    sc = kernels.batch_scores(df.filter("split = 'val'"), fits, maps)
    cost = scoring.accuracy_cost(sc.withColumn("pred_label", F.when(F.col("score") > 0, 1.0).otherwise(0.0)), ["trial_id"]).first()["cost"]
    assert cost <= min(y.mean(), 1 - y.mean()) + 0.05
