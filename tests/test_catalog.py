from __future__ import annotations

import pytest

from factloom.plans import catalog
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert assert_same(catalog.QUERIES[name](spark, SMALL), SMALL, catalog.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).columns
    catalog.QUERIES[name](spark, SMALL).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lines_that_differ_in_other_columns_are_judged_once(spark, tmp_path):
    from pyspark.sql import functions as F

    x = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    x.unionAll(x.withColumn("l_suppkey", F.col("l_suppkey") + 1)).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert catalog.QUERIES["fact_validation"](spark, str(tmp_path)).count() == x.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").distinct().count()


def test_measures_are_in_normal_form_before_they_meet(spark):
    above, below = catalog.QUERIES["measure_compare"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "regexp_replace" not in above and "translate" not in above and "regexp_replace" in below
