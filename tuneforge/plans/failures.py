"""Whose fault an exception of a batch fit is, and how a batch is searched for the culprits.

* ``model``: the estimator's own error (raised on the driver, or by its code inside a task with one
  of ``MODEL_ERRORS``). It fails the trial of its candidate.
* ``data``: an error in the rows or the plan (a null feature, a missing column, a cast). It would meet
  every candidate, so it ends the search.
* ``cluster``: lost executors, full disks, memory, a stopped context. It ends the search.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException, PythonException

MODEL, DATA, CLUSTER = "model", "data", "cluster"


class ModelError(ValueError):
    """What an estimator raises for a candidate that it cannot fit."""


#: Names of errors that mean the model's fault when they are raised inside a task.
MODEL_ERRORS = {"ModelError", "FloatingPointError", "ZeroDivisionError", "OverflowError", "LinAlgError"}
_CLUSTER = re.compile(
    r"ExecutorLost|executor \S+ (?:lost|exited)|FetchFailed|MetadataFetchFailed|OutOfMemory|GC overhead|No space left|SparkContext was shut down|stopped SparkContext"
    r"|Lost task|Connection (?:refused|reset)|exited unexpectedly|worker exited|cancelled", re.IGNORECASE)
_RAISED = re.compile(r"^\s*(?:[\w.]*\.)?(\w+(?:Error|Exception))\b", re.MULTILINE)


def failure_class(e: BaseException) -> str:
    if isinstance(e, PythonException):
        names = _RAISED.findall(str(e))
        return MODEL if names and names[-1] in MODEL_ERRORS else CLUSTER if _CLUSTER.search(str(e)) and not names else DATA
    if isinstance(e, PySparkException):
        return CLUSTER if _CLUSTER.search(str(e)) and not re.search("USER_RAISED_EXCEPTION|RAISE_ERROR", str(e)) else DATA
    if isinstance(e, (Py4JError, OSError, MemoryError)):
        return CLUSTER
    return MODEL


def fit_or_bisect(run: Callable[[list[dict]], list[tuple]], batch: list[dict]) -> list[tuple]:
    """The rows of ``run(batch)``. If the model's own error ends the run, each half is run alone, so that
    one bad candidate of n costs about 2 log2(n) further runs and the others keep their results."""
    try:
        return run(batch)
    except Exception as e:
        if failure_class(e) != MODEL:
            raise
        if len(batch) == 1:
            return [(batch[0]["trial_id"], None, "failed", str(e)[:500])]
    half = len(batch) // 2
    return fit_or_bisect(run, batch[:half]) + fit_or_bisect(run, batch[half:])
