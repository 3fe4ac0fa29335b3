"""Every report against its SQL on the test tables."""

import oracle
import pytest

from packetloom.plans.catalog import reports

REPORTS = reports()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(REPORTS))
def test_report(spark, con, sf_dir, name):
    problem, _, _ = oracle.difference(spark, con, REPORTS[name], sf_dir)
    assert problem is None, problem


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
