"""Every registered query against its SQL, on the smallest supplied tables."""

from __future__ import annotations

import pytest

from mnemolake.plans import registry
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    con = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, con.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
