"""Every registered query against its SQL."""

import pytest

import __spark_entry__
from orderlens.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf), duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_has_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_running_best_and_digests_are_of_all_rows(spark, sf):
    assert QUERIES["window_running_best"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert {r.perm_idx for r in QUERIES["composition_digest"](spark, sf).select("perm_idx").distinct().collect()} == set(range(10))


def test_entry_names():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
