"""Document version chains: successors, heads, components, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.graph import connected_components
from factloom.session import stored


def successors(docs: DataFrame) -> DataFrame:
    """``(doc_id, new_id, new_type, new_parsed_at)``: the first document by id that replaces each; dangling edges are ignored."""
    new = docs.where("prev_id is not null").groupBy(F.col("prev_id").alias("doc_id")).agg(F.min("doc_id").alias("new_id"))
    new = new.join(docs.select("doc_id"), "doc_id", "left_semi")
    return new.join(docs.select(F.col("doc_id").alias("new_id"), F.col("source_type").alias("new_type"), F.col("parsed_at").alias("new_parsed_at")), "new_id").select("doc_id", "new_id", "new_type", "new_parsed_at")


def with_status(docs: DataFrame) -> DataFrame:
    """``docs`` with ``superseded``: whether any document declares it as its previous edition."""
    old = docs.where("prev_id is not null").select(F.col("prev_id").alias("doc_id"), F.lit(True).alias("superseded")).distinct()
    return docs.join(old, "doc_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def heads(docs: DataFrame) -> DataFrame:
    """``(group_id, head_id)`` of groups with exactly one document that nothing replaces."""
    live = with_status(docs).where("group_id is not null and not superseded")
    return live.groupBy("group_id").agg(F.min("doc_id").alias("head_id"), F.count("*").alias("n")).where("n = 1").drop("n")


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, chain)``: documents tied by edition edges or groups; the chain is its smallest id."""
    ids = docs.select("doc_id")
    edges = docs.where("prev_id is not null").select(F.col("doc_id").alias("src"), F.col("prev_id").alias("dst")).join(ids.withColumnRenamed("doc_id", "dst"), "dst", "left_semi").select("src", "dst")
    first = Window.partitionBy("group_id")
    groups = docs.where("group_id is not null").select(F.col("doc_id").alias("src"), F.min("doc_id").over(first).alias("dst"))
    found = connected_components(edges.unionAll(groups))
    return ids.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("chain"))


def distances(docs: DataFrame) -> DataFrame:
    """``(head_id, doc_id, distance)``: steps along declared previous editions to the end of the chain; one that returns to itself ends there.

    Jumps double, so the number of rounds grows with the logarithm of the longest chain. A
    round that reaches no document anew is the last one.
    """
    jumps = stored(docs.where("prev_id is not null").select("doc_id", F.col("prev_id").alias("to")).distinct(), "edges")
    reach = stored(heads(docs).select("head_id", F.col("head_id").alias("doc_id"), F.lit(0).alias("distance")), "reached")
    known, length = reach.count(), 1
    while True:
        further = reach.join(jumps, "doc_id").select("head_id", F.col("to").alias("doc_id"), (F.col("distance") + length).alias("distance"))
        reach = stored(reach.unionAll(further).groupBy("head_id", "doc_id").agg(F.min("distance").alias("distance")), "reached")
        before, known = known, reach.count()
        if known == before:
            return reach.where("distance > 0")
        after = jumps.select(F.col("doc_id").alias("to"), F.col("to").alias("end"))
        jumps, length = stored(jumps.join(after, "to").select("doc_id", F.col("end").alias("to")).distinct(), "jumps"), 2 * length


def ends(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, head_id)``: the end of the way that ``steps`` ``(doc_id, new_id)``, one for each document, take from each of ``nodes``.

    Ways double in length each round, so rounds grow with the logarithm of the longest. What
    still moves after as many rounds as there are documents to the power of two is a cycle,
    and is left out.
    """
    way = stored(nodes.join(steps, "doc_id", "left").select("doc_id", F.coalesce("new_id", "doc_id").alias("head_id")), "ways")
    rounds = max(way.count(), 2).bit_length()
    for _ in range(rounds):
        after = way.select(F.col("doc_id").alias("head_id"), F.col("head_id").alias("end"))
        moved = stored(way.join(after, "head_id").select("doc_id", "head_id", F.col("end").alias("end")), "ways")
        still = moved.where("head_id <> end").isEmpty()
        way = moved.select("doc_id", F.col("end").alias("head_id"))
        if still:
            break
    return way.join(steps.select(F.col("doc_id").alias("head_id")), "head_id", "left_anti").select("doc_id", "head_id")
