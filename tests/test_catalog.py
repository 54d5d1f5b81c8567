"""Every registered query against its SQL oracle."""

from __future__ import annotations

import pytest

from storelens import catalog
from tests.compare import assert_same, views


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir).toPandas(), views(sf_dir).execute(catalog.ORACLE_SQL[name]).df())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"funnel_windows_approx"}


def test_approximate_sessions_are_close(spark, sf_dir):
    exact = {(r.window_start, r.stage): r.sessions for r in catalog.QUERIES["funnel_windows"](spark, sf_dir).collect()}
    for r in catalog.QUERIES["funnel_windows_approx"](spark, sf_dir).collect():
        assert abs(r.sessions - exact[r.window_start, r.stage]) <= max(1, 0.15 * exact[r.window_start, r.stage])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
