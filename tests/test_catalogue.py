"""Every catalogue query against its SQL counterpart, at the smallest scale."""

import os

import pytest

import __spark_entry__ as driver
from tabprobe.plans.catalogue import QUERIES
from tabprobe.plans.oracle import ORACLE
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_but_the_library_generator_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"generate_tasks_mt19937"}


def test_entry(spark):
    assert driver.entry(spark).columns == ["table_id", "fmt", "table_text", "n_chars"]


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, database, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(found, database.execute(ORACLE[name]).df()) is None
