import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tuneforge.functions.hashing import hash_below, hash_uniform, md5_heads
from tuneforge.operators import kernels, mlp, trees
from tuneforge.operators.packed import packed_rows, packed_sum, unpacked


def test_packed_rows_hold_every_row(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3))
    df = spark.createDataFrame([([float(v) for v in r], float(i)) for i, r in enumerate(x)], "features array<double>, n double").repartition(3)
    blocks = packed_rows(df, 3, ("n",))
    assert blocks.count() < 10

    def add(batch, total):
        for v, n in unpacked(batch, 3, ("n",)):
            total[:3] += n @ v
            total[3] += len(v)

    assert packed_sum(blocks, add, 4) == pytest.approx([*(np.arange(700) @ x), 700])


def test_cosine_and_monomials():
    t = np.random.default_rng(0).uniform(-500, 500, (64, 33))
    assert np.abs(kernels.cosine(t.copy()) - np.cos(t)).max() < 2e-15
    assert kernels.cosine(np.array([1e9]))[0] == np.cos(1e9) and np.isnan(kernels.cosine(np.array([np.nan]))[0])
    x, y = np.random.default_rng(1).uniform(-1, 1, (2, 20, 5))
    for degree in range(7):
        found = (kernels.monomial_features(x, degree) * kernels.monomial_features(y, degree)).sum(axis=1)
        assert np.allclose(found, (x * y).sum(axis=1) ** degree)


def test_quantile_bins_compute_a_value_once(spark):
    """Bins are sought in vectors: the plan does not repeat the value for each cut."""
    df = spark.range(200).selectExpr("string(id) key", "array(double(id % 50), CASE WHEN id = 7 THEN double('nan') ELSE -double(id) END) features", "1.0D label", "'train' split")
    binning = trees.Binning("quantile", 4, cuts=[[10.0, 20.0, 30.0], [-100.0, -50.0]])
    binned = trees.apply_binning(df, binning, 2)
    assert "lambda" not in binned._jdf.queryExecution().optimizedPlan().toString()
    for r in binned.collect():
        i = int(r["key"])
        assert r["bins"] == [sum(c < i % 50 for c in binning.cuts[0]), 2 if i == 7 else sum(c < -i for c in binning.cuts[1])]


def test_batch_costs_are_those_of_the_scores(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 2)), rng.integers(0, 2, 300)
    df = spark.createDataFrame([([float(a), float(b)], float(c)) for (a, b), c in zip(x, y)], "features array<double>, label double")
    fits = [kernels.Fit(i, ("linear",), 1.0, -1, rng.normal(size=2), 0.1 * i) for i in range(3)]
    blocks, maps = packed_rows(df, 2, ("label",)), kernels.FeatureMaps(2)
    for f in fits:
        d = x @ f.w + f.b
        assert kernels.batch_costs(blocks, fits, maps, "rmse")[f.trial_id] == pytest.approx(np.sqrt(((y - d) ** 2).mean()))
        assert kernels.batch_costs(blocks, fits, maps, "acc")[f.trial_id] == pytest.approx(1 - ((d > 0) == y).mean())
    assert kernels.batch_costs(packed_rows(df.limit(0), 2, ("label",)), fits, maps, "acc") == {}


def test_md5_by_vectors():
    texts = ["", "k", "é" * 9, "x" * 48, "x" * 49, "y" * 50, "z" * 200, *(f"-{i}-" * (i % 11) for i in range(5000))]
    prefixes = [b"", b"13:0:1", b"13:7:1", b"13:12:10"]
    found = md5_heads(pa.array(["left out", *texts])[1:], prefixes)
    for p, own in zip(prefixes, found):
        assert own.tolist() == [int(hashlib.md5(p + t.encode()).hexdigest()[:8], 16) for t in texts]
    assert md5_heads(pa.array([], pa.string()), prefixes).shape == (4, 0)


def test_hash_below_is_the_uniform_below(spark):
    df = spark.range(3000).withColumn("id", F.when(F.col("id") > 5, F.col("id")))
    for share in (0.0, 1e-12, 0.05, 0.25, 0.7, 1.0, 2.0):
        assert df.where(hash_below(share, 3, F.col("id")) != (hash_uniform(3, F.col("id")) < share)).count() == 0


@pytest.mark.parametrize("opt", ["sgd", "RMSprop", "adam", "nadam", "adamax", "adadelta"])
def test_shards_side_by_side_equal_each_alone(opt):
    rng = np.random.default_rng(4)
    c = {"batch_size": 8, "neurons": 3, "optimizer": opt, "learning_rate": 0.1, "hiddenactivation": "tanh", "activation": "sigmoid", "loss": "binary_crossentropy"}
    w = mlp.init_params(0, 2, 3, 1)
    state = w, [np.zeros_like(w) for _ in range(mlp.n_slots(opt))], 5
    shards = [(rng.normal(size=(n, 2)), rng.integers(0, 2, n).astype(float)) for n in (3, 40, 8, 29)]
    for (X, y), (got, slots, t, loss) in zip(shards, mlp.train_shards(c, state, shards, 2)):
        own, own_slots, at, total = w, state[1], 5, 0.0
        for i in range(0, len(y), 8):
            part, g = mlp.loss_and_gradient(own, X[i : i + 8], y[i : i + 8], 2, 3, "tanh", "sigmoid", "binary_crossentropy")
            own, own_slots = mlp.step(opt, 0.1, own, own_slots, at + 1, g)
            at, total = at + 1, total + part
        assert np.allclose(got, own) and t == at and loss == pytest.approx(total)
        assert all(np.allclose(a, b) for a, b in zip(slots, own_slots))


def test_epoch_order_is_by_hash_then_key():
    keys = [str(i % 700) for i in range(900)]
    drawn = [(hashlib.md5(f"4:2:{k}".encode()).hexdigest()[:8], k, i) for i, k in enumerate(keys)]
    assert mlp.in_epoch_order(4, 2, keys).tolist() == [i for _, _, i in sorted(drawn)]
