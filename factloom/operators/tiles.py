"""Joins of rows that share a key, where one key may hold very many rows.

A key with more than ``BOUND`` rows is cut into parts of about that size by a hash of the
rows' ids. Each two parts meet in a tile of their own, so the pairs of one key are spread
over as many tasks as it has tiles, none with more than ``BOUND`` squared pairs to look
at; a part is sent once to each of its tiles. Other keys have one part and one tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import stored

#: Rows of a key that meet in one task, per side.
BOUND = 4_096


def parts(rows: DataFrame, keys: list[str], bound: int | None = None) -> DataFrame | None:
    """``(*keys, parts)`` of the keys with more than ``bound`` rows, which are few; None without any."""
    bound = BOUND if bound is None else bound
    # the counts settle how rows are joined, so they are taken first, over the keys alone
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > bound)
    large = stored(large.select(*keys, F.ceil(F.col("n") / bound).cast("int").alias("parts")), "large-keys")
    return None if large.isEmpty() else large


def part(id_: Column, n: Column) -> Column:
    """Which of ``n`` parts of its key a row is in."""
    return F.pmod(F.xxhash64(id_), n).cast("int")


def within(rows: DataFrame, keys: list[str], id_col: str, bound: int | None = None) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Both sides of a join of ``rows`` with themselves on ``keys``, as ``a`` and ``b``, its condition, and where two rows come from two parts.

    Rows of two parts meet once, in one order or the other. Within one part they meet both
    ways, and the caller's condition picks one.
    """
    large = parts(rows, keys, bound)
    on = lambda names: [F.col(f"a.{c}") == F.col(f"b.{c}") for c in names]
    if large is None:
        same = on(keys)
        apart = F.lit(False)
        left, right = rows, rows
    else:
        cut = rows.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        cut = cut.withColumn("_p", part(F.col(id_col), F.col("parts")))
        left = cut.select("*", F.explode(F.sequence(F.col("_p"), F.col("parts") - 1)).alias("_j")).withColumn("_i", F.col("_p"))
        right = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("_i")).withColumn("_j", F.col("_p"))
        same = on([*keys, "_i", "_j"])
        apart = F.col("a._i") < F.col("a._j")
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return left.alias("a"), right.alias("b"), condition, apart


def between(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, bound: int | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of an inner join on ``keys``, as ``a`` and ``b``, and its condition; a large key of either side is cut into parts that meet the other side's."""
    here, there = parts(left, keys, bound), parts(right, keys, bound)
    names = list(keys)
    if here is not None or there is not None:
        sides = []
        for rows, id_, own, other in ((left, left_id, here, there), (right, right_id, there, here)):
            for large, name in ((own, "_own"), (other, "_other")):
                rows = rows.withColumn(name, F.lit(1)) if large is None else rows.join(large.withColumnRenamed("parts", name), keys, "left").withColumn(name, F.coalesce(name, F.lit(1)))
            sides.append((rows.withColumn("_p", part(F.col(id_), F.col("_own"))), F.sequence(F.lit(0), F.col("_other") - 1)))
        left = sides[0][0].select("*", F.explode(sides[0][1]).alias("_j")).withColumn("_i", F.col("_p"))
        right = sides[1][0].select("*", F.explode(sides[1][1]).alias("_i")).withColumn("_j", F.col("_p"))
        names += ["_i", "_j"]
    condition = F.col(f"a.{names[0]}") == F.col(f"b.{names[0]}")
    for c in names[1:]:
        condition = condition & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return left.alias("a"), right.alias("b"), condition
