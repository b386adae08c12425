"""Every registered report against its SQL form on DuckDB."""

import pytest
from compare import difference, duck

import __spark_entry__ as driver
from playtrail.plans.catalog import reports
from playtrail.plans.kept import KEPT, kept_oracle
from playtrail.plans.oracle import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_same_names():
    assert set(reports()) == set(oracle()) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(oracle()))
def test_report_equals_sql(spark, con, name):
    result = reports()[name](spark, SF)
    assert difference(con, oracle()[name], result) is None


def test_same_kept_names():
    assert set(KEPT) == set(kept_oracle()) and not set(KEPT) & set(reports())


@pytest.mark.parametrize("name", sorted(KEPT))
def test_kept_table_equals_sql(spark, con, name):
    assert difference(con, kept_oracle()[name], KEPT[name](spark, SF)) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 20
