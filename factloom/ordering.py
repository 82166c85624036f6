"""A total order over rows of any number: their places, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import stored


def numbered(rows: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``rows`` with their place in a total order, from 0, in the column ``name``.

    Rows are sorted in ranges; what stands before a range is a sum over the ranges before
    it, and only their sizes meet. ``monotonically_increasing_id`` parts equal rows, so
    that even these fill several ranges.
    """
    tied = stored(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{label}-unsorted")
    keys = [*order, F.col("_tie")]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    ranged = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), f"{label}-sorted")
    part, within = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(ranged.groupBy(part.alias("part")).count().collect())  # a row for each task of the sort
    before, starts = 0, []
    for size in sizes:
        starts.append((size["part"], before))
        before += size["count"]
    if not starts:
        return ranged.withColumn(name, F.lit(0).cast("bigint")).drop("_place")
    listed = rows.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    # broadcast: a row for each task of the sort
    placed = ranged.join(F.broadcast(listed), part == F.col("_part"))
    return placed.withColumn(name, F.col("_before") + within).drop("_part", "_before", "_place")
