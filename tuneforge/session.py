"""Session helpers: local sessions for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "tuneforge") -> SparkSession:
    """A local session configured like the driver's test sessions (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when none is configured.

    On a cluster the directory must be the shared folder named by ``spark.checkpoint.dir``;
    a machine-local folder is only taken where driver and executors are one process
    (``local`` and ``local[...]`` masters: tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="tuneforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: For tables whose rows are blocks of rows. Left alone, Parquet looks at the size of a row group only after a hundred
#: rows, and a reader holds a whole row group of long values: a row group has few blocks, and none is kept in a dictionary.
_BLOCKS = {"parquet.block.row.count.limit": "8", "parquet.enable.dictionary": "false"}
#: Bytes of an Arrow batch between the JVM and a Python worker while rows are blocks.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_inside: dict[str, list] = {}
_inside_lock = Lock()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_BYTES`` at most for the jobs inside (Spark's default is 64 MB, which a JVM holds
    outside its heap, up to three times while a buffer grows, for each running task and worker). Threads may nest."""
    own = spark._jsparkSession.sessionUUID()
    with _inside_lock:
        depth, before = _inside.get(own) or (0, spark.conf.get(_BATCH_CONF, None))
        _inside[own] = [depth + 1, before]
        if not depth and (before is None or _bytes(before) > BATCH_BYTES):
            spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        with _inside_lock:
            depth, before = _inside.pop(own)
            if depth > 1:
                _inside[own] = [depth - 1, before]
            elif before is None:
                spark.conf.unset(_BATCH_CONF)
            else:
                spark.conf.set(_BATCH_CONF, before)


def _bytes(text: str) -> int:
    """Bytes that a size in a Spark setting (``67108864b``, ``64m``) names."""
    number = text.lower().rstrip("bkmgtp")
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[text.lower()[len(number) : len(number) + 1]]


def cut_lineage(df: DataFrame, blocks: bool = False) -> DataFrame:
    """Cut the lineage of an iterative state table: write it as parquet into the shared
    checkpoint folder and read it back.

    A written table is a fresh relation: unlike ``Dataset.checkpoint`` it carries no
    statistics or inferred constraints of the plan that produced it, so iterating
    (swarm moves with self-joins, boosting rounds) never compounds optimizer work.
    Reading back also prunes columns at the scan. ``blocks``: its rows are blocks of rows, long binary values.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    df.write.options(**(_BLOCKS if blocks else {})).parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by ``keys`` (all columns if none are given) into the session's
    ``spark.sql.shuffle.partitions``: one narrow shuffle, the same at every size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *(keys or df.columns))


def spread_if_few(df: DataFrame, key: str = "key") -> DataFrame:
    """Spread by ``key`` a table in fewer partitions than half the slots; a larger one stays as it lies."""
    if df.rdd.getNumPartitions() * 2 > df.sparkSession.sparkContext.defaultParallelism:
        return df
    return spread(df, key) if key in df.columns else spread(df)


def materialize(df: DataFrame, key: str = "key") -> DataFrame:
    """Write a table that an iterative search will scan many times, spread if it lies in few partitions."""
    return cut_lineage(spread_if_few(df, key))
