"""Sums of packed vectors: what a batch of models adds up over the rows, one array a partition.

A partition adds its rows into one long array of doubles (gradients of all models, or the sums
of a Newton step) and gives it in blocks of ``WIDTH`` numbers. Blocks are summed in two levels,
``FAN_IN`` partitions at a time and then the rest, each in the order of the partitions, so that the
driver gets the total alone and the result does not depend on the order of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneforge.session import cut_lineage, small_batches

#: Bytes of numbers that a block of rows holds at most: what the JVM and a worker hold at once is a few blocks.
BLOCK_BYTES = 1_000_000
WIDTH, FAN_IN = 4096, 64
_ROW = "part int, block int, vals array<double>"


def _add(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    vals = table.column("vals").combine_chunks()
    total = vals.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).sum(axis=0)
    return pa.table({"part": table.column("part").slice(0, 1), "block": table.column("block").slice(0, 1), "vals": pa.array([total], pa.list_(pa.float64()))})


def packed_sum(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """The sum over all rows of what ``add(batch, total)`` adds to an array of ``size`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, any_row = TaskContext.get().partitionId(), np.zeros(size), False
        for batch in batches:
            if len(batch):
                add(batch, total)
                any_row = True
        if any_row:
            pieces = [total[i : i + WIDTH] for i in range(0, size, WIDTH)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], names=["part", "block", "vals"])

    parts = rows.mapInArrow(run, _ROW)
    some = parts.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("run")).applyInArrow(_add, _ROW)
    total = np.zeros(size)
    with small_batches(rows.sparkSession):
        found = some.groupBy("block").applyInArrow(_add, _ROW).select("block", "vals").collect()  # the size is that of the models
    for r in found:
        total[r["block"] * WIDTH : r["block"] * WIDTH + len(r["vals"])] = r["vals"]
    return total


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of arrays of ``width`` doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed_rows(rows: DataFrame, width: int, others: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(features, *others)`` as blocks: the features of a block's rows in ``x``, and each other
    column, as doubles in a binary value. Written once, so that a pass reads arrays and computes nothing anew."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * max(width, 1)))
        for batch in batches:
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                numbers = [matrix(some.column("features"), width), *(some.column(c).to_numpy(zero_copy_only=False) for c in others)]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, float).tobytes()], pa.binary()) for v in numbers], names=["x", *others])

    return cut_lineage(rows.select("features", *others).mapInArrow(pack, ", ".join(f"{c} binary" for c in ("x", *others))), blocks=True)


def unpacked(batch: pa.RecordBatch, width: int, others: tuple[str, ...] = ()) -> Iterator[tuple[np.ndarray, ...]]:
    """The matrix of features and the other columns of each block of :func:`packed_rows`."""
    for i in range(len(batch)):
        x, *rest = (np.frombuffer(batch.column(c)[i].as_buffer(), float) for c in ("x", *others))
        yield x.reshape(-1, width), *rest
