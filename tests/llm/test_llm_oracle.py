"""The llm queries that SQL can express against DuckDB."""

import pytest

from compare import differences
from quillon.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir) == []
