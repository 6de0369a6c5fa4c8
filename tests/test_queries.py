"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import checks.catalog  # noqa: F401 - registers the queries
from checks import base
from checks.compare import compare, duck
from tests.conftest import SMALL

QUERIES, SQL = base.QUERIES, base.SQL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("key", [k for k in QUERIES if k in SQL])
def test_same_as_sql(spark, con, key):
    message, _ = compare(spark, con, SMALL, key, QUERIES[key], SQL[key])
    assert message.startswith("ok"), message


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"pii_type", "strategy", "n_items"} <= set(rows[0].asDict())
