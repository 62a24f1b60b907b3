"""Every registered query with SQL against DuckDB, the others for rows and a stable schema."""

import pytest

from compare import differences
from quillon.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.collect() is not None
