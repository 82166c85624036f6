from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import tiles
from factloom.plans import catalog
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"


def keyed(spark, sizes, seed=1):
    pick = random.Random(seed)
    rows = [(k, i, pick.randrange(5)) for k, n in sizes.items() for i in range(n)]
    pick.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, id int, v int").repartition(3)


@pytest.mark.parametrize("bound", [10, 64, 10_000])
def test_each_two_rows_of_a_key_meet_once(spark, bound):
    rows, frame = keyed(spark, {"hot": 150, "warm": 31, "one": 1, None: 9, "two": 2})
    a, b, same, apart = tiles.within(frame, ["k"], "id", bound)
    got = a.join(b, same & (apart | (F.col("a.id") < F.col("b.id")))).select("a.k", F.least("a.id", "b.id"), F.greatest("a.id", "b.id")).collect()
    want = {(k, i, j) for k, n in {"hot": 150, "warm": 31, "two": 2}.items() for i in range(n) for j in range(i + 1, n)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("bound", [8, 40, 10_000])
def test_sides_of_two_tables_meet_once(spark, bound):
    left, x = keyed(spark, {"hot": 90, "a": 3, "only left": 50})
    right, y = keyed(spark, {"hot": 25, "a": 70, "only right": 50}, 2)
    a, b, same = tiles.between(x, y, ["k"], "id", "id", bound)
    got = Counter(tuple(r) for r in a.join(b, same).select("a.k", F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect())
    assert got == Counter((k, i, j) for k, i, _ in left for k2, j, _ in right if k == k2)


def test_a_hot_key_is_spread_over_tasks(spark):
    """100,000 rows of one key: no tile gets more than a small part of them."""
    frame = spark.range(100_000).selectExpr("'hot' as k", "cast(id as int) as id")
    a, b, _, _ = tiles.within(frame, ["k"], "id")
    for side in (a, b):
        sizes = [r["count"] for r in side.groupBy("k", "_i", "_j").count().collect()]
        assert len(sizes) > 300 and max(sizes) < 1.2 * tiles.BOUND


@pytest.mark.parametrize("name", ["conflict_scored", "cross_attribute_scan", "conflict_channels_identity_b"])
def test_queries_in_tiles_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(tiles, "BOUND", 7)
    assert assert_same(catalog.QUERIES[name](spark, SMALL), SMALL, catalog.ORACLES[name]) > 0
