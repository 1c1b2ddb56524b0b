"""Estimator registry: add an algorithm as (default space, default params, batched fit).

``fit_batch(spark, data, candidates, task, score, options) -> DataFrame(trial_id, cost, status, error)``
receives the prepared rows ``(key, features, label, split)`` and a decoded candidate table,
and must score every candidate in shared passes over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Estimator:
    name: str
    default_space: Callable[[str], dict]
    default_params: Callable[[str], dict]
    fit_batch: Callable[..., DataFrame]
    fit_model: Callable[..., object] | None = None


_REGISTRY: dict[str, Estimator] = {}


def register_estimator(name: str, default_space, default_params, fit_batch, fit_model=None) -> Estimator:
    """Register a new estimator; ``default_space``/``default_params`` take the task name.
    ``fit_model(spark, data, candidate, task, score, options)`` fits one candidate to a model."""
    if not name or not isinstance(name, str):
        raise ValueError("estimator name must be a non-empty string")
    est = Estimator(name, default_space, default_params, fit_batch, fit_model)
    _REGISTRY[name] = est
    return est


def registered_estimators() -> dict[str, Estimator]:
    return dict(_REGISTRY)


def get_estimator(name: str) -> Estimator:
    if name not in _REGISTRY:
        raise ValueError(f"unknown estimator {name!r}")
    return _REGISTRY[name]
