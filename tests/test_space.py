"""Search-space semantics: decode goldens, cardinalities, grid order and decode/encode round trip."""

import math

from pyspark.sql import functions as F

from tuneforge.operators import candidates as cand
from tuneforge.operators.space import SearchSpace


def test_default_cardinalities():
    expect = {
        ("xgboost", "binary classification"): 21 * 10 * 69 * 31,
        ("xgboost", "regression"): 3 * 21 * 10 * 69 * 31,
        ("gbdt", "regression"): 2 * 21 * 10 * 69 * 31,
        ("svm", "regression"): 3 * 100 * 100 * 7,
        ("mlp", "binary classification"): 45360,
    }
    for (est, task), n in expect.items():
        assert SearchSpace.default(est, task).total == n


def test_golden_decode(spark):
    space = SearchSpace.default("mlp", "binary classification")
    pos = [3.8997699, 0.28725911, 4.21218138, 1.41200923, 0.84643591]
    df = spark.createDataFrame([(0, pos)], "trial_id long, pos array<double>")
    row = cand.decode_candidates(df, space).select("params.*").first()
    assert (row["optimizer"], row["learning_rate"], row["neurons"], row["hiddenactivation"], row["activation"]) == (
        "nadam", 0.29, 4, "sigmoid", "sigmoid")
    # defaults merged underneath, decoded wins
    assert row["batch_size"] == 12 and row["loss"] == "binary_crossentropy"


def test_all_strings_rule():
    import pytest

    # categorical only if every item is a string; a mixed list is numeric and invalid
    with pytest.raises(ValueError):
        SearchSpace.from_dict({"mixed": ["a", 1, 0]})
    assert SearchSpace.from_dict({"c": ["a", "b"]}).dims[0].is_categorical


def test_grid_order_is_product_order(spark):
    space = SearchSpace.from_dict({"k": ["x", "y"], "lr": [0.1, 0.3, 1], "d": [1, 2, 0]})
    rows = cand.decode_candidates(cand.grid_enumerate(spark, space), space).orderBy("trial_id").select("params.*").collect()
    import itertools

    expect = list(itertools.product(["x", "y"], [0.1, 0.2, 0.3], [1, 2]))
    assert [(r["k"], r["lr"], r["d"]) for r in rows] == expect


def test_off_grid_lower_bound_rounds_below():
    # arange(0.05, 1 + 1e-6, 1) rounded to 0 decimals starts at 0
    s = SearchSpace.from_dict({"p": [0.05, 1, 1]})
    assert s.dims[0].cardinality == math.ceil((1 + 1e-6 - 0.05) / 0.1)


def test_random_candidates_are_grid_points(spark):
    space = SearchSpace.default("mlp", "binary classification")
    rc = cand.random_candidates(spark, space, seed=3, n=500)
    grid = cand.grid_enumerate(spark, space).withColumnRenamed("trial_id", "grid_index").withColumnRenamed("pos", "gpos")
    j = rc.join(grid, "grid_index")
    assert j.filter(F.col("pos") != F.col("gpos")).count() == 0
    assert j.count() == 500
