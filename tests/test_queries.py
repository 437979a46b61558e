"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, spark_rows, sql_rows
from tidelog import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    result = plans.queries()[name](spark, SF)
    if name in plans.oracle_sql():
        assert spark_rows(result) == sql_rows(con, plans.oracle_sql()[name])
    else:
        assert result.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
