"""Every registered query equals its DuckDB SQL (rows, values, column types) at sf0.001.

``python tests/oracle_check.py`` runs the same comparison at sf0.01.
"""

import pytest

from shared_paths import SF001
from oracle_check import compare, duck

from prefspark.oracle import ORACLE
from prefspark.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF001), con, ORACLE[name])
    assert ok, msg


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLE)
