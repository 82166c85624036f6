from __future__ import annotations

from pyspark.sql import functions as F

from factloom.ordering import numbered


def test_equal_rows_fill_several_ranges(spark):
    rows = spark.range(4000).selectExpr("'a' as k").repartition(4)
    got = sorted(r.place for r in numbered(rows, [F.col("k").asc()], "place", "test").collect())
    assert got == list(range(4000))


def test_places_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as int) as k", "if(id % 50 = 0, null, id % 3) as g").repartition(5)
    got = numbered(rows, [F.col("g").asc_nulls_first(), F.col("k").desc()], "place", "test").orderBy("place").collect()
    assert [(r.g, r.k) for r in got] == sorted(((r.g, r.k) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))
    assert [r.place for r in got] == list(range(1000))


def test_no_rows(spark):
    assert numbered(spark.range(0), [F.col("id").asc()], "place", "test").collect() == []
