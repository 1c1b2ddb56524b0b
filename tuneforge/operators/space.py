"""Search spaces, default parameters and validation (driver-side, immutable).

A space maps a parameter name to either a list of strings (categorical; encoded as the
index 0..len-1) or ``[lo, hi, decimals]`` (numeric). A parameter is categorical iff
*every* list item is a string.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

ESTIMATORS = ("xgboost", "gbdt", "svm", "mlp")
TASKS = ("regression", "binary classification")
SCORES = ("rmse", "acc", "auc")

# ---- fixed values: default search spaces and default parameters of the reference ----
DEFAULT_SPACES = {
    ("xgboost", "binary classification"): {
        "learning_rate": [0.1, 0.3, 2],
        "max_depth": [1, 10, 0],
        "n_estimators": [2, 70, 0],
        "subsample": [0.7, 1, 2],
    },
    ("xgboost", "regression"): {
        "objective": ["reg:linear", "reg:tweedie", "reg:gamma"],
        "learning_rate": [0.1, 0.3, 2],
        "max_depth": [1, 10, 0],
        "n_estimators": [2, 70, 0],
        "subsample": [0.7, 1, 2],
    },
    ("gbdt", "binary classification"): {
        "learning_rate": [0.1, 0.3, 2],
        "max_depth": [1, 10, 0],
        "n_estimators": [2, 70, 0],
        "subsample": [0.7, 1, 2],
    },
    ("gbdt", "regression"): {
        "objective": ["tweedie", "regression"],
        "learning_rate": [0.1, 0.3, 2],
        "max_depth": [1, 10, 0],
        "n_estimators": [2, 70, 0],
        "subsample": [0.7, 1, 2],
    },
    ("svm", None): {
        "kernel": ["linear", "rbf", "poly"],
        "gamma": [0.1, 10, 1],
        "C": [0.1, 10, 1],
        "degree": [0, 6, 0],
    },
    ("mlp", None): {
        "optimizer": ["RMSprop", "adam", "sgd", "adamax", "nadam", "adadelta"],
        "learning_rate": [0.1, 0.3, 2],
        "neurons": [1, 40, 0],
        "hiddenactivation": ["relu", "sigmoid", "tanh"],
        "activation": ["relu", "sigmoid", "tanh"],
    },
}

DEFAULT_PARAMS = {
    ("xgboost", "binary classification"): {
        "learning_rate": 0.01, "max_depth": 6, "n_estimators": 40, "subsample": 0.99,
        "objective": "binary:logistic", "eval_metric": ["aucpr", "auc"],
    },
    ("xgboost", "regression"): {
        "learning_rate": 0.01, "max_depth": 6, "n_estimators": 40, "subsample": 0.99,
        "objective": "reg:tweedie", "eval_metric": ["rmse"],
    },
    ("gbdt", "regression"): {
        "objective": "tweedie", "learning_rate": 0.01, "max_depth": 6, "n_estimators": 40,
        "subsample": 0.99, "boosting_type": "gbdt", "eval_metric": "rmse",
    },
    ("gbdt", "binary classification"): {
        "objective": "binary", "learning_rate": 0.01, "max_depth": 6, "n_estimators": 40,
        "subsample": 0.99, "boosting_type": "gbdt", "eval_metric": ["auc"],
    },
    ("mlp", "binary classification"): {
        "batch_size": 12, "epochs": 50, "shuffle": True, "neurons": 13, "hiddenactivation": "sigmoid",
        "activation": "sigmoid", "learning_rate": 0.01, "mode": "auto",
        "optimizer": "adam", "metrics": ["binary_accuracy"], "loss": "binary_crossentropy",
    },
    ("mlp", "regression"): {
        "batch_size": 12, "epochs": 50, "shuffle": True, "neurons": 13, "hiddenactivation": "sigmoid",
        "activation": "sigmoid", "learning_rate": 0.01, "mode": "auto",
        "optimizer": "RMSprop", "metrics": ["mse"], "loss": "mse",
    },
    ("svm", None): {"kernel": "rbf", "C": 5, "gamma": 5},
}
# ---- end of fixed values ----


def default_space(estimator: str, task: str) -> dict:
    validate(estimator, task)
    return dict(DEFAULT_SPACES.get((estimator, task)) or DEFAULT_SPACES[(estimator, None)])


def default_params(estimator: str, task: str) -> dict:
    validate(estimator, task)
    return dict(DEFAULT_PARAMS.get((estimator, task)) or DEFAULT_PARAMS[(estimator, None)])


def validate(estimator: str, task: str, score: str | None = None) -> None:
    from tuneforge.plans.registry import registered_estimators

    if estimator not in ESTIMATORS and estimator not in registered_estimators():
        raise ValueError(f"unknown estimator {estimator!r}")
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    if score is not None:
        if score not in SCORES:
            raise ValueError(f"unknown score {score!r}")
        if score in ("acc", "auc") and task != "binary classification":
            raise ValueError(f"score {score!r} needs task 'binary classification'")


@dataclass(frozen=True)
class Dim:
    name: str
    categories: tuple[str, ...] | None
    lo: float
    hi: float
    decimals: int

    @property
    def is_categorical(self) -> bool:
        return self.categories is not None

    @property
    def step(self) -> float:
        return 10 ** (-1 * self.decimals)

    @property
    def cardinality(self) -> int:
        """Length of the axis ``arange(lo, hi + 1e-6, 10^-decimals)``."""
        return max(0, math.ceil((self.hi + 0.000001 - self.lo) / self.step))

    @property
    def spark_type(self) -> str:
        if self.is_categorical:
            return "string"
        return "bigint" if self.decimals == 0 else "double"


@dataclass(frozen=True)
class SearchSpace:
    dims: tuple[Dim, ...]
    defaults: dict = field(default_factory=dict, hash=False, compare=False)

    @staticmethod
    def from_dict(params: dict, defaults: dict | None = None) -> "SearchSpace":
        dims = []
        for name, spec in params.items():
            spec = list(spec)
            if all(isinstance(v, str) for v in spec):
                if not spec:
                    raise ValueError(f"categorical parameter {name!r} has no values")
                dims.append(Dim(name, tuple(spec), 0.0, float(len(spec) - 1), 0))
            else:
                if len(spec) != 3:
                    raise ValueError(f"numeric parameter {name!r} must be [lo, hi, decimals]")
                lo, hi, dec = spec
                if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in spec):
                    raise ValueError(f"numeric parameter {name!r} needs numbers [lo, hi, decimals]; "
                                     "a categorical list must contain only strings")
                if int(dec) != dec or dec < 0:
                    raise ValueError(f"decimals of {name!r} must be a non-negative integer")
                if hi < lo:
                    raise ValueError(f"parameter {name!r} has hi < lo")
                dims.append(Dim(name, None, float(lo), float(hi), int(dec)))
        return SearchSpace(tuple(dims), dict(defaults or {}))

    @staticmethod
    def default(estimator: str, task: str) -> "SearchSpace":
        return SearchSpace.from_dict(default_space(estimator, task), default_params(estimator, task))

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dims]

    @property
    def n_dims(self) -> int:
        return len(self.dims)

    @property
    def lower(self) -> list[float]:
        return [d.lo for d in self.dims]

    @property
    def upper(self) -> list[float]:
        return [d.hi for d in self.dims]

    @property
    def cardinalities(self) -> list[int]:
        return [d.cardinality for d in self.dims]

    @property
    def total(self) -> int:
        """Number of grid combinations: the product of axis sizes (never materialised)."""
        return math.prod(self.cardinalities)
