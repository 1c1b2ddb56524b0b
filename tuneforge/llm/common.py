"""Helpers shared by the operators: scratch tables, size-checked broadcasts, Arrow text blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.session import ensure_checkpoint_dir

#: An id set is broadcast up to so many rows (8 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def scratch_path(spark: SparkSession, kind: str = "tables") -> str:
    """A new path in the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: every later use reads
    the files, so a lost executor recomputes no more than its own tasks."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written narrow table for broadcast if it is counted and has ``rows`` rows at most;
    otherwise leave it to a shuffled join, which gives the same result."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows of one doc_id apart: the id and a hash of the text."""
    return F.col("doc_id"), F.xxhash64(text_or_empty())


def without_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` less the rows named in ``bad`` (doc_id, text_hash); all columns of docs stay."""
    gone = small(bad.select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash")).distinct())
    doc_id, text_hash = row_key(docs)
    same = doc_id.eqNullSafe(F.col("__gone_id")) & (text_hash == F.col("__gone_hash"))
    return docs.join(gone, same, "left_anti")


def blocks(column: pa.Array, max_bytes: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split an Arrow binary column into runs of rows of about ``max_bytes`` (a longer text
    stands alone): first row, last row (exclusive), the bytes, and the row offsets in them."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def span_text(spans: str, keep: Column | None = None) -> Column:
    """``kind:start:end`` of an array of span structs, comma-joined in the array's order."""
    return F.concat_ws(",", F.transform(F.col(spans) if keep is None else keep, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def span_counts(spans: str, kinds: dict[str, str]) -> list[Column]:
    """A long column for each kind, under its output name: how many spans are of that kind."""
    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")
    return [count(kind).alias(name) for kind, name in kinds.items()]


def base_spans(spans: str, kinds: list[str]) -> Column:
    return F.filter(F.col(spans), lambda s: s["kind"].isin(kinds))
