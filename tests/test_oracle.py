"""Every registered query with SQL agrees with it; the others return rows."""

import oracle
import pytest

from segmentry import workload

SQL = workload.oracle_sql()


@pytest.fixture(scope="module")
def database(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, folder, database):
    assert oracle.compare(workload.queries()[name](spark, folder), database, SQL[name]) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(workload.queries())
