"""Every query of the reference's operators against its SQL."""

import pytest

from tests.oracle import DATA, connect, rows_of, rows_of_sql
from weftline.queries import ORACLE_SQL, QUERIES

@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    got = QUERIES[name](spark, DATA)
    cols, want = rows_of_sql(connect(), ORACLE_SQL[name])
    assert sorted(got.columns) == cols
    assert rows_of(got) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
