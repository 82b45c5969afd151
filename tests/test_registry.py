"""Every registered query against DuckDB on the same files."""

import compare
import pytest

import __spark_entry__ as entry_points
from siltworks.registry import ORACLES, QUERIES



@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    names, found = compare.spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = compare.duck_rows(duck, ORACLES[name])
    assert names == expected_names
    assert found == expected


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
