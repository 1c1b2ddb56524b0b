"""What a task holds of tables whose rows are blocks of rows does not grow with the rows of its partition."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tuneforge import session
from tuneforge.operators import packed, trees
from tuneforge.plans import catalog

MB = 1 << 20


def row_groups(df):
    """Bytes of each row group of a written table."""
    meta = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in df.inputFiles()]
    return [m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)]


def test_packed_rows_have_small_row_groups_and_batches(spark):
    n = 150  # 60,000 rows of 100 features, 48 MB in one partition
    df = spark.range(400, numPartitions=1).select(F.explode(F.array_repeat(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.rand(3) + i + F.col("id")), n)).alias("features"))
    blocks = packed.packed_rows(df, 100)
    assert len(row_groups(blocks)) > 4 and max(row_groups(blocks)) < 9 * MB

    def largest(batch, total):
        total[0] = max(total[0], batch.nbytes)
        total[1] += sum(len(x) for x, in packed.unpacked(batch, 100))

    most, rows = packed.packed_sum(blocks, largest, 2)
    assert rows == 400 * n and most < packed.BLOCK_BYTES + session.BATCH_BYTES


def test_booster_state_has_small_row_groups_and_leaves_the_heap_alone(spark, monkeypatch):
    """regression_walkthrough: 30 candidates over partitions of millions of rows."""
    written, levels = [], []  # tables, and how states between them are held
    monkeypatch.setattr(trees, "cut_lineage", lambda df, **kw: written.append(session.cut_lineage(df, **kw)) or written[-1])
    cands = [{"trial_id": k, "objective": "reg:linear", "learning_rate": 0.1 + k / 10, "max_depth": 2, "n_estimators": 3, "subsample": 0.8 if k % 2 else 1.0} for k in range(30)]
    df = spark.range(80_000, numPartitions=1).selectExpr("string(id) key", "array(int(id % 16), int(id % 7), int(id % 5)) bins", "double(id % 16 + id % 7) label", "if(id % 4 = 0, 'val', 'train') split")
    monkeypatch.setattr(trees, "spread_if_few", lambda df: df)
    persist = type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, level: ("label" in self.columns and levels.append(level)) or persist(self, level))
    trees.fit_boosted_trees(spark, df, cands, "rmse", trees.BoostConfig(checkpoint_every=2, n_bins=16))
    assert len(written) == 2  # the first state, and the second round's with the scores of all candidates: 19 MB
    assert sum(row_groups(written[1])) > 18 * MB and len(row_groups(written[1])) > 2 and max(row_groups(written[1])) < 9 * MB
    assert levels and not any(level.useMemory for level in levels)


def test_batch_setting_is_put_back(spark):
    before = spark.conf.get(session._BATCH_CONF)
    with pytest.raises(ZeroDivisionError), session.small_batches(spark):
        with session.small_batches(spark):
            assert session._bytes(spark.conf.get(session._BATCH_CONF)) == session.BATCH_BYTES
        assert session._bytes(spark.conf.get(session._BATCH_CONF)) == session.BATCH_BYTES
        1 / 0
    assert spark.conf.get(session._BATCH_CONF) == before
    assert [session._bytes(x) for x in ("67108864b", "64m", "1g", "5")] == [64 * MB, 64 * MB, 1 << 30, 5]
    try:
        spark.conf.set(session._BATCH_CONF, "1m")  # a smaller one is left
        with session.small_batches(spark):
            assert spark.conf.get(session._BATCH_CONF) == "1m"
        assert spark.conf.get(session._BATCH_CONF) == "1m"
    finally:
        spark.conf.set(session._BATCH_CONF, before)


def test_best_first_state_with_draws(spark, monkeypatch):
    """fit_gbdt: rows carry their keys and draws, and the cost is the AUC."""
    written = []
    monkeypatch.setattr(trees, "cut_lineage", lambda df, **kw: written.append(session.cut_lineage(df, **kw)) or written[-1])
    monkeypatch.setattr(trees, "spread_if_few", lambda df: df)
    cands = [{"trial_id": k, "objective": "binary", "learning_rate": 0.3, "max_depth": 2, "n_estimators": 3, "subsample": 0.8 + k % 3 / 10} for k in range(18)]
    df = spark.range(90_000, numPartitions=1).selectExpr("string(id) key", "array(int(id % 16), int(id % 7)) bins", "double(id % 16 + id % 7 > 9) label", "if(id % 4 = 0, 'val', 'train') split")
    res = trees.fit_boosted_trees(spark, df, cands, "auc", trees.BoostConfig(checkpoint_every=1, n_bins=16, max_leaves=31, early_stopping_rounds=20))
    assert {r.status for r in res.costs.collect()} == {"ok"}
    assert len(written) == 3 and all(max(row_groups(w)) < 9 * MB for w in written) and sum(row_groups(written[-1])) > 12 * MB


@pytest.mark.parametrize("name", ["fit_boosted_trees", "search_pso_boosted", "rebuild_boosted"])
def test_queries_write_blocks_in_small_row_groups(spark, monkeypatch, name):
    """However many blocks a partition has: quantile passes and booster states alike."""
    written = []
    for module in (packed, trees):
        monkeypatch.setattr(module, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(module, "cut_lineage", lambda df, **kw: written.append(session.cut_lineage(df, **kw)) or written[-1])
    assert getattr(catalog, f"q_{name}")(spark, SF_SMALL).count()
    assert {"x", "f"} - {c for df in written for c in df.columns} == ({"x"} if name != "search_pso_boosted" else set())
    rows = [m.row_group(i).num_rows for df in written for f in df.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for i in range(m.num_row_groups)]
    assert sum(rows) > 100 and max(rows) <= 8
