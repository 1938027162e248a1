"""Every registered notebook query against its DuckDB SQL."""

from __future__ import annotations

import pytest
from conftest import SF_DIR, duck_rows, spark_rows

from fieldbook import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF_DIR)) == duck_rows(duck, catalog.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
