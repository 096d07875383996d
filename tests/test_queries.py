"""Every named query against its SQL in DuckDB, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check import compare, duck
from dayprint.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


# Fits of hundreds of boosted trees take minutes even on few rows; check.py runs
# them, and test_models.py fits the same families with fewer trees. The text
# operators have tests of their own.
SLOW = {"gbt_regressor", "gbt_classifier", "train_all", "model_catalog", "catalog_cross_validation"}
OWN_TESTS = {n for n in entry.queries() if n not in QUERIES}


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in SLOW | OWN_TESTS])
def test_matches_sql(spark, con, name):
    line = compare(spark, con, FOLDER, name)
    assert line.startswith("ok"), line


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["transport_mode"] for r in rows} == {"Walk", "Bike", "Bus", "EV", "Car"}
