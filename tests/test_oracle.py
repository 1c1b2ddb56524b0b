"""Every query with oracle SQL matches DuckDB on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.check_oracle import duck_con, rows_of

SQL = E.oracle_sql()
QUERIES = E.queries()


def test_every_query_has_a_callable():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    scols = [c.lower() for c in df.columns]
    srows = [tuple(r) for r in df.collect()]
    rel = duck_con(SF_SMALL).sql(SQL[name])
    dcols = [c.lower() for c in rel.columns]
    drows = rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(srows, scols) == rows_of(drows, dcols)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert set(df.columns) >= {"trial_id", "cost"}
