"""A Merkle manifest of a table: a tree for each group of rows, a tree over the groups, and a lookup proof for each row.

A leaf is the SHA-256 of a row's fields. In each group the leaves ascend by id; every
``FAN`` consecutive nodes become the SHA-256 of their digests, until one remains, the
group's subroot. Subroots, in the order of their groups, become the root likewise.

The node table has a row for each run of ``FAN`` siblings, at every level of every tree.
Which runs a leaf needs follows from its index, the size of its group and the place of
the group alone. The leaves of one run need the same runs above them, so they explode
these coordinates together, look them up in the node table, put them in order and fold
each leaf with them. No run has more than ``FAN`` digests and no key gathers more than
the leaves below it: the runs at the top, which all leaves need, are few and broadcast.

Fields are null-safe: a null is ``-``, a value its UTF-8 bytes and their number, so no two
rows share a leaf unless all fields are equal. Null ids come first in their group; null
groups are a group of their own, before the others. Rows that repeat an id are ordered by
their leaf, and equal rows stand side by side. Texts are hashed whole, however long.
Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.sqltext import ascii_lower
from factloom.ordering import numbered
from factloom.session import stored

#: Nodes that become one; a power of two.
FAN = 16
_BITS = FAN.bit_length() - 1
#: Runs of siblings that are broadcast, from the top: at most this many, some KB each.
TOP_RUNS = 2_048
#: The tree over the groups' subroots. The trees of groups count from 0.
OVER = -1


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 bytes after their number and a colon; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(digests: Column) -> Column:
    """The digest of digests one after the other."""
    return F.sha2(F.array_join(digests, ""), 256)


@dataclass
class Forest:
    """Trees by level: for each level the stored runs ``(tree, level, run, nodes array<string>)``, and the last digest of each tree."""

    levels: list[DataFrame]
    tops: DataFrame


def height(n: int) -> int:
    """Levels of runs in a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grow(leaves: DataFrame, most: int, label: str) -> Forest:
    """The trees over ``leaves (tree, n, idx, node)``; ``n`` is the number of a tree's leaves, and ``most`` the largest."""
    nodes, levels = leaves.where("n > 1").select("tree", "n", "idx", "node"), []
    tops = [leaves.where("n = 1").select("tree", "node")]
    for level in range(height(most)):
        runs = nodes.groupBy("tree", "n", F.call_function("shiftright", F.col("idx"), F.lit(_BITS)).alias("run"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("x"))  # FAN at most
        runs = stored(runs.select("tree", F.lit(level).alias("level"), "run", "n", F.transform("x", lambda x: x["node"]).alias("nodes")), f"{label}-level")
        levels.append(runs.select("tree", "level", "run", "nodes"))
        above = runs.select("tree", "n", F.col("run").alias("idx"), folded(F.col("nodes")).alias("node"))
        alone = F.col("n") <= F.lit(FAN ** (level + 1))
        tops.append(above.where(alone).select("tree", "node"))
        nodes = above.where(~alone)
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return Forest(levels, out)


def _coordinates(levels: int, n: Column, at: Column, tree: Column, first_level: int, step: int) -> Column:
    """The runs that a node at index ``at`` of level 0 needs in a tree of ``n`` leaves: level, run, its place in that run, and in which order to fold."""
    shifted = lambda k: F.call_function("shiftright", at, F.lit(_BITS * k))
    each = [
        F.when(
            n > F.lit(FAN**k),
            F.struct(F.lit(step + k).alias("step"), tree.alias("tree"), F.lit(k).alias("level"), shifted(k + 1).alias("run"), shifted(k).bitwiseAND(F.lit(FAN - 1)).cast("int").alias("slot")),
        )
        for k in range(first_level, levels)
    ]
    kind = "array<struct<step:int,tree:bigint,level:int,run:bigint,slot:int>>"
    return F.filter(F.array(*each), lambda x: x.isNotNull()).cast(kind) if each else F.array().cast(kind)


def _looked_up(asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``asked`` with the ``nodes`` of the runs it names; runs of levels that are few in all are broadcast."""
    sized = sorted(((x.count(), x) for x in levels), key=lambda s: s[0])
    few, many, held = [], [], 0
    for count, runs in sized:
        held += count
        (few if held <= TOP_RUNS else many).append(runs)
    on = ["tree", "level", "run"]
    out = []
    for tables, hint in ((few, F.broadcast), (many, lambda x: x)):
        if tables:
            table = tables[0]
            for more in tables[1:]:
                table = table.unionByName(more)
            out.append(asked.join(hint(table), on))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _fold(start: Column, path: Column) -> Column:
    """The digest at the end of a path of siblings, from a digest at its start."""
    return F.aggregate(path, start, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def _siblings(nodes: Column, slot: Column) -> tuple[Column, Column]:
    """The digests before and after a place of a run."""
    left = F.array_join(F.slice(nodes, F.lit(1), slot), "")
    return left, F.array_join(F.slice(nodes, slot + 2, F.lit(FAN)), "")


def manifest(docs: DataFrame, id_col: str, group_col: str, fields: list[str], tampered: Column | None = None, tampered_when: Column | None = None) -> DataFrame:
    """``(id_col, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row.

    ``fields`` enter a leaf in their order. ``folded_root`` is folded from the row as it is
    checked: where ``tampered_when`` holds, the last field is ``tampered``, and the
    siblings are those of the manifest. ``verified`` tells whether it is the root.
    """
    values = [F.col(c) for c in fields]
    as_checked = leaf_hash(*values[:-1], tampered) if tampered is not None else F.lit(None).cast("string")
    changed = F.when(F.coalesce(tampered_when, F.lit(False)), as_checked) if tampered_when is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf_hash(*values).alias("node"), changed.alias("changed"))
    leaves = numbered(leaves, [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("node").asc()], "at", "merkle-leaves")

    groups = leaves.groupBy("grp").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    groups = stored(numbered(groups, [F.col("grp").asc_nulls_first()], "tree", "merkle-groups"), "merkle-groups")
    sizes = groups.agg(F.count("*"), F.max("n")).first()
    n_groups, most = sizes[0], sizes[1] or 0
    # the table of groups is broadcast only where Spark knows it to be small; else a large group is split as a skewed key
    told = leaves.join(groups.withColumnRenamed("grp", "group"), F.col("grp").eqNullSafe(F.col("group")))
    told = told.select("tree", "n", (F.col("at") - F.col("start")).alias("idx"), "node", "id", "changed")

    run = F.call_function("shiftright", F.col("idx"), F.lit(_BITS))
    requests = told.groupBy("tree", "n", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "node", "id", "changed"))).alias("rows"))  # FAN at most
    requests = stored(requests, "merkle-runs")
    spread = requests.select("tree", "n", F.explode("rows").alias("x")).select("tree", "n", "x.idx", "x.node")
    own = grow(spread, most, "merkle-own")
    subroots = own.tops.select(F.lit(OVER).cast("bigint").alias("tree"), F.lit(n_groups).cast("bigint").alias("n"), F.col("tree").alias("idx"), "node")
    over = grow(subroots, n_groups, "merkle-over")
    top = over.tops.first()
    root = F.lit(top["node"] if top else None)

    # what stands above the run of a leaf: first in the tree of its group, then in the tree of groups
    own_levels, over_levels = height(most), height(n_groups)
    leaf_at = F.call_function("shiftleft", F.col("run"), F.lit(_BITS))
    above = _coordinates(own_levels, F.col("n"), leaf_at, F.col("tree"), 1, 0)
    beyond = _coordinates(over_levels, F.lit(n_groups).cast("bigint"), F.col("tree"), F.lit(OVER).cast("bigint"), 0, own_levels)
    asked = requests.select(F.col("tree").alias("of"), F.col("run").alias("of_run"), F.explode(F.concat(above, beyond)).alias("c")).select("of", "of_run", "c.*")
    if own.levels[1:] or over.levels:
        found = _looked_up(asked, own.levels[1:] + over.levels)
        left, right = _siblings(F.col("nodes"), F.col("slot"))
        subroot = F.when((F.col("tree") == OVER) & (F.col("level") == 0), F.col("nodes")[F.col("slot")])
        found = found.groupBy("of", "of_run").agg(F.array_sort(F.collect_list(F.struct("step", left.alias("left"), right.alias("right")))).alias("path"), F.max(subroot).alias("subroot"))
    else:
        found = docs.sparkSession.createDataFrame([], "of bigint, of_run bigint, path array<struct<step:int,left:string,right:string>>, subroot string")
    known = requests.join(found, (F.col("tree") == F.col("of")) & (F.col("run") == F.col("of_run")), "left")
    path = F.coalesce("path", F.array().cast("array<struct<step:int,left:string,right:string>>"))
    nodes = F.transform("rows", lambda x: x["node"])
    # one group: its subroot is the root
    known = known.select("n", path.alias("path"), F.coalesce("subroot", root).alias("subroot"), nodes.alias("nodes"), F.posexplode("rows").alias("slot", "x"))
    left, right = _siblings(F.col("nodes"), F.col("slot"))
    first = F.when(F.col("n") > 1, F.array(F.struct(F.lit(-1).alias("step"), left.alias("left"), right.alias("right")))).otherwise(F.array().cast("array<struct<step:int,left:string,right:string>>"))
    whole = known.select("x", "subroot", F.concat(first, "path").alias("path"))
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    checked = _fold(F.coalesce("x.changed", "x.node"), F.col("path"))
    out = whole.select(F.col("x.id").alias(id_col), F.col("x.node").alias("leaf"), "subroot", root.cast("string").alias("root"), F.sha2(proof, 256).alias("proof_sha256"), checked.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by source; where 5 divides the crc32 of an id, the text is checked with A-Z lower-cased. Null ids are not tampered with."""
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))
    return manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], lowered, marked)
