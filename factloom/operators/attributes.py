"""Attribute resolution from proposed clusters, and the audit channels for pairs of facts.

A model proposes which predicates of a subject mean one attribute; :func:`resolve` keeps
what the facts bear out. Pairs of facts are then a conflict, silent, or for people to review.

Proposals are two frames. ``clusters``: ``(subject_id, cluster, canonical_name, value_kind,
ord, alias, span)``, a row for each alias. ``texts``: ``(subject_id, cluster, value_kind,
a, b)``, a row for each two values that are said to mean the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import detect, versions
from factloom.ordering import numbered
from factloom.rules import RuleContext
from factloom.session import stored

if TYPE_CHECKING:
    import pandas as pd

#: When string values are prose rather than an enumeration, samples of a predicate, predicates of a request; fixed values.
FREE_TEXT_CHARS, FREE_TEXT_VALUES = 20, 8
SAMPLES, BUDGET = 6, 60
#: Source types whose facts take part, by default; a fixed value.
SOURCE_TYPES = ("pricing",)
#: How a tax basis reads in a sample; fixed values.
TAX_WORDS = {"inclusive": "含税", "exclusive": "不含税", "unknown": "税口径未说明"}
TEXT_KINDS = ("text", "enumeration")


def eligible(facts: DataFrame, docs: DataFrame, source_types: tuple[str, ...] = SOURCE_TYPES) -> DataFrame:
    """Facts of documents of the types that attributes are resolved for."""
    ids = docs.where(F.col("source_type").isin(*source_types)).select("doc_id").distinct()
    return X.with_unpacked(X.with_packed(facts, "fact_id").join(ids, "doc_id"), "fact_id").select(*facts.columns)


def text_key(text: Column) -> Column:
    """A value without white space, in lower case: how equivalent texts are told apart."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def rendered(facts: DataFrame) -> Column:
    """A fact's object as a sample shows it: entity or scalar, unit, currency, tax basis."""
    col = lambda c, t="string": F.col(c) if c in facts.columns else F.lit(None).cast(t)
    scalar = X.scalar_text(F.col("object_type"), col("object_string"), col("object_number", "double"), col("object_date", "date"), col("object_bool", "boolean"))
    tax = F.lit(None).cast("string")
    for basis, word in TAX_WORDS.items():
        tax = F.when(col("tax_basis") == basis, word).otherwise(tax)
    shown = F.concat_ws(" ", scalar, F.nullif(col("measure_unit"), F.lit("")), F.nullif(col("currency"), F.lit("")), tax)
    return F.coalesce(col("object_entity_name"), col("object_entity_id"), shown)


def shard_descriptors(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """``(subject_id, pred_fold, predicate, samples, source_docs, source_types)`` of eligible facts: what a predicate is about.

    ``predicate`` is its first written form, ``samples`` its first distinct objects.
    """
    return _descriptors(facts, docs.select("doc_id", "filename", "source_type"), "left").drop("units")


def _descriptors(facts: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """:func:`shard_descriptors` of facts that are joined with ``docs``, with the ``units`` of each predicate. Facts are sent to their documents, then to their predicates, and nowhere else."""
    unit = X.normalize_dimension(F.col("measure_unit")) if "measure_unit" in facts.columns else F.lit(None).cast("string")
    x = X.with_packed(facts.select("subject_id", "pred_fold", "predicate", "fact_id", "doc_id", rendered(facts).alias("_s"), unit.alias("_u")), "fact_id")
    key = ["subject_id", "pred_fold"]
    x = x.join(docs, "doc_id", how).drop("doc_id").repartition(*key)
    # one row a distinct object, of which only the first few are gathered
    sets = {"source_docs": "filename", "source_types": "source_type", "units": "_u"}
    first = X.with_unpacked(x, "fact_id").groupBy(*key, "_s").agg(F.min(F.struct("predicate", "fact_id")).alias("at"), F.min("predicate").alias("predicate"), *[F.collect_set(c).alias(s) for s, c in sets.items()])
    n = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    sample = F.when(F.col("n") <= SAMPLES, F.struct("n", "_s"))
    per = first.withColumn("n", n).groupBy(*key).agg(F.min("predicate").alias("predicate"), F.array_sort(F.collect_list(sample)).alias("s"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(s)))).alias(s) for s in sets])
    return per.select(*key, "predicate", F.transform("s", lambda v: v["_s"]).alias("samples"), *sets)


#: Subjects of a run whose requests are filled in one task.
RUN = 20_000


def _filler(budget: int):
    """How requests fill up along a run of subjects, from any filling at its start.

    Returns ``filled(sizes, pieces, start)``: for each filling in ``start``, the filling at
    the end and the number of requests opened, and the request of each subject counted
    from those opened before. 0 is no open request.
    """
    import numpy as np  # the closures are sent to workers by value

    def filled(sizes, pieces, start):
        filling, opened = np.array(start), np.zeros(len(start), np.int64)
        places = np.zeros((len(sizes), len(start)), np.int64)
        for k, (n, cut) in enumerate(zip(sizes, pieces, strict=True)):
            if n > budget:
                places[k] = opened
                opened = opened + cut
                filling = np.zeros_like(filling)
            else:
                opens = (filling == 0) | (filling + n > budget)
                opened = opened + opens
                filling = np.where(opens, n, filling + n)
                places[k] = opened - 1
        return filling, opened, places

    return filled


def pack_shards(descriptors: DataFrame, names: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(pack, subject_id, pred_fold, split)``: subjects of two predicates or more, in requests of up to ``budget`` predicates, numbered from 0.

    Subjects keep together and come in the order of their names; one with more predicates is
    cut by the first document of its predicates, and has requests of its own. How a request
    fills up depends on all subjects before it, so runs of subjects are worked off for
    every filling that they may begin with; what each run really begins with follows from
    these tables, a row of numbers for each run, and its requests from that.
    """
    first_doc = F.coalesce(F.get("source_docs", F.lit(0)), F.lit(""))
    rows = stored(descriptors.select(F.col("subject_id").cast("string").alias("subject_id"), "pred_fold", "predicate", first_doc.alias("doc")), "shards")
    per = rows.groupBy("subject_id").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    # subjects over the budget: their documents in the order of predicates, filled up to the budget
    docs = rows.join(per.where(F.col("n") > budget), "subject_id").groupBy("subject_id", "doc").agg(F.min("predicate").alias("first"), F.count("*").cast("int").alias("n"))
    filling = F.struct(F.lit(0).alias("part"), F.lit(0).alias("filled"), F.array().cast("array<struct<doc:string,part:int>>").alias("out"))

    def fill(acc: Column, g: Column) -> Column:
        opens = (acc["filled"] > 0) & (acc["filled"] + g["n"] > budget)
        part = acc["part"] + opens.cast("int")
        return F.struct(part.alias("part"), F.when(opens, g["n"]).otherwise(acc["filled"] + g["n"]).alias("filled"), F.concat(acc["out"], F.array(F.struct(g["doc"].alias("doc"), part.alias("part")))).alias("out"))

    listed = docs.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("first", "doc", "n"))).alias("g"))  # the documents of one subject
    cuts = stored(listed.select("subject_id", F.explode(F.aggregate("g", filling, fill, lambda acc: acc["out"])).alias("c")).select("subject_id", "c.doc", "c.part"), "cuts")
    pieces = cuts.groupBy("subject_id").agg((F.max("part") + 1).alias("pieces"))
    order = per.join(pieces, "subject_id", "left").join(names.select(F.col("subject_id").cast("string").alias("subject_id"), "name"), "subject_id", "left")
    order = numbered(order.withColumn("pieces", F.coalesce("pieces", F.lit(1))), [F.col("name").asc_nulls_first(), F.col("subject_id").asc()], "at", "shard-order")
    runs = stored(order.select("subject_id", "n", "pieces", "at", F.floor(F.col("at") / RUN).alias("run")), "shard-runs")
    filled, states = _filler(budget), list(range(budget + 1))

    def ends(run: "pd.DataFrame") -> "pd.DataFrame":
        import pandas as pd

        run = run.sort_values("at")
        filling, opened, _ = filled(run["n"], run["pieces"], states)
        return pd.DataFrame({"run": [run["run"].iloc[0]], "filling": [filling.tolist()], "opened": [opened.tolist()]})

    start, first, begins = 0, 0, []
    for r in sorted(runs.groupBy("run").applyInPandas(ends, "run bigint, filling array<bigint>, opened array<bigint>").collect()):  # budget numbers for RUN subjects
        begins.append((r.run, start, first))
        start, first = r.filling[start], first + r.opened[start]

    def places(run: "pd.DataFrame") -> "pd.DataFrame":
        run = run.sort_values("at")
        _, _, at = filled(run["n"], run["pieces"], [run["filling"].iloc[0]])
        return run.assign(pack=run["first"] + at[:, 0])[["subject_id", "n", "pack"]]

    known = descriptors.sparkSession.createDataFrame(begins, "run bigint, filling int, first bigint")
    placed = runs.join(known, "run").groupBy("run").applyInPandas(places, "subject_id string, n int, pack bigint")
    out = rows.join(placed, "subject_id").join(cuts, ["subject_id", "doc"], "left")
    return out.select((F.col("pack") + F.coalesce("part", F.lit(0))).alias("pack"), "subject_id", "pred_fold", (F.col("n") > budget).alias("split"))


@dataclass
class Resolution:
    """What is kept of the proposals: ``bindings (subject_id, pred_fold, canonical_key, canonical_name, value_kind, dimension, trusted)``,
    ``texts (subject_id, a, b)`` as text keys with a before b, ``rejected (subject_id, a, b)`` predicates whose merge the
    units forbid, the ``facts`` that take part, which are those of documents of ``source_types``, and ``discarded (subject_id, cluster, what, reason)``."""

    facts: DataFrame
    source_types: tuple[str, ...]
    bindings: DataFrame
    texts: DataFrame
    rejected: DataFrame
    discarded: DataFrame


def resolve(facts: DataFrame, docs: DataFrame, clusters: DataFrame, texts: DataFrame, source_types: tuple[str, ...] = SOURCE_TYPES) -> Resolution:
    """Proposals, checked against the facts that take part.

    An alias must be a predicate of its subject and counts at its first use; a span that
    occurs in the predicate or its samples makes it trusted. Measures merge within one
    unit; predicates without units join the largest group, untrusted.
    """
    own = eligible(_whole(facts), docs, source_types)
    known = _descriptors(_whole(facts), docs.where(F.col("source_type").isin(*source_types)).select("doc_id", "filename", "source_type"), "inner")
    surface = text_key(F.concat_ws(" ", F.array("predicate"), "samples"))
    # what is kept is read by every channel, and each step here by several others
    x = clusters.withColumn("pred_fold", X.fold(F.col("alias"))).join(known.select("subject_id", "pred_fold", surface.alias("surface"), "units"), ["subject_id", "pred_fold"], "left")
    use = Window.partitionBy("subject_id", "pred_fold").orderBy("cluster", "ord")
    x = stored(x.withColumn("n", F.when(F.col("surface").isNotNull(), F.row_number().over(use))), "proposals")
    dropped = x.where("surface is null or n > 1").select("subject_id", "cluster", F.col("alias").alias("what"), F.when(F.col("surface").isNull(), "unknown_predicate").otherwise("used_before").alias("reason"))
    span = text_key(F.coalesce("span", F.lit("")))
    x = x.where("n = 1").withColumn("trusted", (span != "") & F.contains("surface", span)).select("subject_id", "cluster", "canonical_name", "value_kind", "pred_fold", "trusted", "units")
    several = x.groupBy("subject_id", "cluster").agg(F.count("*").alias("aliases")).where("aliases > 1").select("subject_id", "cluster")
    x = x.join(several, ["subject_id", "cluster"], "left_semi")

    # units: an alias takes the one that most aliases of its cluster have, the first by name if several do
    measures = x.where("value_kind = 'measure'")
    spread = measures.select("subject_id", "cluster", "pred_fold", F.explode("units").alias("dim"))
    votes = spread.groupBy("subject_id", "cluster", "dim").agg(F.count("*").alias("votes"))
    chosen = spread.join(votes, ["subject_id", "cluster", "dim"]).groupBy("subject_id", "cluster", "pred_fold").agg(F.min_by("dim", F.struct(-F.col("votes"), "dim")).alias("dimension"), F.count("*").alias("dims"))
    chosen = stored(chosen, "chosen-units")
    sized = chosen.groupBy("subject_id", "cluster", "dimension").agg(F.count("*").alias("size"))
    biggest = sized.where("size > 1").groupBy("subject_id", "cluster").agg(F.min_by("dimension", F.struct(-F.col("size"), "dimension")).alias("largest"))
    any_unit = votes.select("subject_id", "cluster").distinct().withColumn("any_unit", F.lit(True))
    m = measures.join(chosen, ["subject_id", "cluster", "pred_fold"], "left").join(sized, ["subject_id", "cluster", "dimension"], "left").join(biggest, ["subject_id", "cluster"], "left").join(any_unit, ["subject_id", "cluster"], "left")
    loose = F.col("any_unit").isNull()
    kept = loose | F.coalesce(F.col("size") > 1, F.lit(False)) | (F.col("dimension").isNull() & F.col("largest").isNotNull())
    # no unit anywhere: one group, and nothing to check trust against
    trusted = F.when(loose, F.col("trusted")).otherwise(F.col("trusted") & F.col("dimension").isNotNull() & (F.col("dims") == 1))
    m = m.where(kept).select("subject_id", "canonical_name", "value_kind", "pred_fold", trusted.alias("trusted"), F.coalesce("dimension", "largest").alias("dimension"))
    others = x.where("value_kind <> 'measure'").select("subject_id", "canonical_name", "value_kind", "pred_fold", "trusted", F.lit(None).cast("string").alias("dimension"))
    bound = m.unionByName(others)
    bindings = bound.select("subject_id", "pred_fold", X.confluence_key(F.col("canonical_name"), F.col("value_kind"), F.col("dimension")).alias("canonical_key"), "canonical_name", "value_kind", "dimension", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    left, right = chosen.alias("l"), chosen.alias("r")
    clash = left.join(right, (F.col("l.subject_id") == F.col("r.subject_id")) & (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.pred_fold") < F.col("r.pred_fold")) & (F.col("l.dimension") != F.col("r.dimension")))
    rejected = clash.select(F.col("l.subject_id").alias("subject_id"), F.col("l.pred_fold").alias("a"), F.col("r.pred_fold").alias("b")).distinct()

    values = own.where("object_type = 'string'").select("subject_id", text_key(F.col("object_string")).alias("v")).distinct()
    t = texts.where(F.col("value_kind").isin(*TEXT_KINDS)).select("subject_id", "cluster", F.least(text_key(F.col("a")), text_key(F.col("b"))).alias("a"), F.greatest(text_key(F.col("a")), text_key(F.col("b"))).alias("b")).where("a <> '' and b <> '' and a <> b")
    backed = t.join(values.withColumnRenamed("v", "a"), ["subject_id", "a"], "left_semi").join(values.withColumnRenamed("v", "b"), ["subject_id", "b"], "left_semi")
    unbacked = t.join(backed.select("subject_id", "a", "b").distinct(), ["subject_id", "a", "b"], "left_anti").select("subject_id", "cluster", F.concat_ws(" = ", "a", "b").alias("what"), F.lit("value_not_found").alias("reason"))
    return Resolution(own, source_types, stored(bindings, "bindings"), stored(backed.select("subject_id", "a", "b").distinct(), "texts"), stored(rejected, "rejected"), dropped.unionByName(unbacked))


def pair_identity(pairs: DataFrame, bindings: DataFrame) -> DataFrame:
    """``pairs`` ``(subject_id, pred_a, pred_b)`` with ``identity``: A for one predicate, B for two merged into one attribute, else null.

    B pairs also have ``canonical_key, canonical_name, value_kind, trusted``, as their first predicate is bound.
    """
    side = lambda s: bindings.select("subject_id", F.col("pred_fold").alias(f"pred_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("canonical_key", "canonical_name", "value_kind", "trusted")])
    x = pairs.join(side("a"), ["subject_id", "pred_a"], "left").join(side("b"), ["subject_id", "pred_b"], "left")
    merged = F.coalesce(F.col("canonical_key_a") == F.col("canonical_key_b"), F.lit(False))
    kind = F.when(F.col("pred_a") == F.col("pred_b"), "A").when(merged, "B")
    named = {c: F.when(kind == "B", F.col(f"{c}_a")) for c in ("canonical_key", "canonical_name", "value_kind", "trusted")}
    return x.select(*pairs.columns, kind.alias("identity"), *[v.alias(c) for c, v in named.items()])


def texts_equivalent(pairs: DataFrame, texts: DataFrame, a: Column, b: Column) -> DataFrame:
    """``pairs`` (with ``subject_id``) with ``texts_equivalent``: whether two values are said to mean the same, either way round."""
    ka, kb = text_key(a), text_key(b)
    x = pairs.withColumns({"_a": F.least(ka, kb), "_b": F.greatest(ka, kb)})
    known = texts.select("subject_id", F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_t")).distinct()
    x = x.join(known, ["subject_id", "_a", "_b"], "left")
    return x.withColumn("texts_equivalent", F.coalesce("_t", F.lit(False))).drop("_a", "_b", "_t")


def channel_same_attribute(verdict: Column, same_value: Column, equal: Column, eligible: Column, texts_equivalent: Column, free_text: Column) -> Column:
    """``struct(kind, reason)`` for two facts with one literal predicate; null kind is silence."""
    measure = eligible & (verdict != "not_measure")
    kind = (
        F.when(measure & (verdict == "consistent") & same_value, None)
        .when(measure & (verdict == "consistent"), "conflict")
        .when(measure & (verdict == "missing"), "pending_review")
        .when(measure & (verdict == "conflict"), "cross_attribute_review")
        .when(equal, None)
        .when(eligible & texts_equivalent, "normalized_equivalent")
        .when(eligible & free_text, "pending_review")
        .otherwise("conflict")
    )
    reason = (
        F.when(measure & (verdict == "missing"), "measure_anchor_missing")
        .when(measure & (verdict == "conflict"), "measure_anchor_conflict")
        .when(measure | equal, None)
        .when(eligible & texts_equivalent, "same_predicate_text_equivalence")
        .when(eligible & free_text, "literal_text_difference")
    )
    return F.struct(kind.alias("kind"), reason.alias("reason"))


def channel_merged_attribute(verdict: Column, same_value: Column, equal: Column, texts_equivalent: Column, trusted: Column) -> Column:
    """``struct(kind, reason)`` for two facts whose different predicates were merged into one attribute."""
    not_measure = verdict == "not_measure"
    kind = (
        F.when(not_measure & (equal | texts_equivalent), "normalized_equivalent")
        .when(not_measure, "pending_review")
        .when((verdict == "consistent") & same_value, "normalized_equivalent")
        .when(verdict == "conflict", "cross_attribute_review")
        .otherwise("pending_review")
    )
    reason = (
        F.when(not_measure & equal, "merged_attribute_equal_value")
        .when(not_measure & texts_equivalent, "model_text_equivalence")
        .when(not_measure, "merged_attribute_value_differs")
        .when((verdict == "consistent") & same_value, "merged_measure_equal_value")
        .when(verdict == "conflict", "merged_pair_anchor_conflict")
        .when((verdict == "consistent") & trusted, "model_merged_unconfirmed")
        .otherwise("merged_pair_anchor_unverified")
    )
    return F.struct(kind.alias("kind"), reason.alias("reason"))


def channel_cross_attribute(verdict: Column, same_value: Column, rejected_merge: Column) -> Column:
    """``struct(kind, reason)`` for number facts of one subject under different predicates that were not merged."""
    clash = (verdict == "conflict") & rejected_merge
    near = verdict.isin("consistent", "missing") & ~F.coalesce(same_value, F.lit(True))
    reason = F.when(clash, "measure_anchor_conflict_split").when(near, "same_unit_different_value_not_comerged")
    return F.struct(F.when(reason.isNotNull(), "cross_attribute_review").alias("kind"), reason.alias("reason"))


def free_text_predicates(facts: DataFrame) -> DataFrame:
    """``(subject_id, pred_fold)`` whose string values are long or many."""
    stripped = F.regexp_replace("object_string", r"(?U)^\s+|\s+$", "")
    g = facts.where("object_type = 'string'").groupBy("subject_id", "pred_fold").agg(F.max(F.length(stripped)).alias("longest"), F.count_distinct("object_string").alias("values"))
    return g.where((F.col("longest") > FREE_TEXT_CHARS) | (F.col("values") > FREE_TEXT_VALUES)).select("subject_id", "pred_fold")


CARRIED = ["object_type", "object_string", "object_number", "measure_unit", "currency", "tax_basis"]
_NULLS = {"object_string": "string", "currency": "string", "tax_basis": "string"}


def _measured(pairs: DataFrame) -> DataFrame:
    """Pairs ``old, new`` with ``v``: their comparison as measures, and ``equal``: whether their objects are."""
    side = lambda s: {"number": F.when(F.col(f"{s}.object_type") == "number", F.col(f"{s}.object_number")), "unit": F.col(f"{s}.measure_unit"), "currency": F.col(f"{s}.currency"), "tax": F.col(f"{s}.tax_basis")}
    return pairs.withColumns({"v": X.measure_compare(side("old"), side("new")), "equal": F.col("old.canon_object") == F.col("new.canon_object")})


def _whole(facts: DataFrame) -> DataFrame:
    return facts.withColumns({c: F.lit(None).cast(t) for c, t in _NULLS.items() if c not in facts.columns})


def _items(x: DataFrame, *more: str) -> DataFrame:
    fact = lambda s, to: [F.col(f"{s}.fact_id").alias(f"fact_{to}"), F.col(f"{s}.predicate").alias(f"predicate_{to}"), F.col(f"{s}.canon_object").alias(f"value_{to}"), F.col(f"{s}.doc_id").alias(f"doc_{to}")]
    return x.where("c.kind is not null").select("subject_id", "c.kind", "c.reason", *fact("old", "a"), *fact("new", "b"), *more)


def same_predicate_pairs(facts: DataFrame, docs: DataFrame, ctx: RuleContext, resolution: Resolution) -> DataFrame:
    """Gated pairs of one predicate with ``c``: what they are once attributes are resolved."""
    f = _whole(facts)
    prose = free_text_predicates(f).withColumn("prose", F.lit(True))
    # whether a predicate is prose is told to facts, as pairs are far more
    live = detect.live_facts(f, docs, ctx).join(prose, ["subject_id", "pred_fold"], "left")
    x = _measured(detect.gated_pairs(live, None, ctx, [*CARRIED, "prose"]))
    own = lambda s: F.coalesce(F.col(f"{s}.source_type").isin(*resolution.source_types), F.lit(False))
    both = own("old") & own("new")
    strings = (F.col("old.object_type") == "string") & (F.col("new.object_type") == "string")
    x = texts_equivalent(x, resolution.texts, F.col("old.object_string"), F.col("new.object_string"))
    c = channel_same_attribute(F.col("v.verdict"), F.coalesce("v.same_value", F.lit(False)), F.col("equal"), both, F.coalesce(strings, F.lit(False)) & F.col("texts_equivalent"), F.coalesce("old.prose", F.lit(False)))
    return x.withColumn("c", c)


def conflicts(facts: DataFrame, docs: DataFrame, ctx: RuleContext, resolution: Resolution) -> DataFrame:
    """Conflict findings once attributes are resolved."""
    return detect.conflicts(facts, docs, ctx, same_predicate_pairs(facts, docs, ctx, resolution).where("c.kind = 'conflict'"))


def same_predicate_channels(facts: DataFrame, docs: DataFrame, ctx: RuleContext, resolution: Resolution) -> DataFrame:
    """Review items of pairs of one predicate."""
    return _items(same_predicate_pairs(facts, docs, ctx, resolution).where("c.kind <> 'conflict'"))


def live_own(facts: DataFrame, docs: DataFrame, ctx: RuleContext, resolution: Resolution) -> DataFrame:
    """Live facts of those that take part; they meet their documents once, before all else."""
    return detect.live_facts(_whole(facts), docs, ctx).where(F.col("source_type").isin(*resolution.source_types))


def merged_channels(facts: DataFrame, docs: DataFrame, ctx: RuleContext, resolution: Resolution) -> DataFrame:
    """Review items of pairs under different predicates that were merged into one attribute; attributes with a multi-valued predicate have none."""
    bound = live_own(facts, docs, ctx, resolution).join(resolution.bindings, ["subject_id", "pred_fold"])
    if ctx.multi_valued:
        mixed = resolution.bindings.where(F.col("pred_fold").isin(*sorted(ctx.multi_valued))).select("subject_id", "canonical_key").distinct()
        bound = bound.join(mixed, ["subject_id", "canonical_key"], "left_anti")
    # an attribute stands in for the predicate, so only its facts meet
    f = bound.withColumn("_literal", F.col("pred_fold")).withColumn("pred_fold", F.col("canonical_key"))
    x = detect.gated_pairs(f, None, ctx, [*CARRIED, "_literal", "canonical_name", "value_kind", "trusted"]).where("old._literal <> new._literal")
    x = texts_equivalent(_measured(x), resolution.texts, F.col("old.object_string"), F.col("new.object_string"))
    textual = F.col("old.value_kind").isin(*TEXT_KINDS) & F.col("texts_equivalent")
    c = channel_merged_attribute(F.col("v.verdict"), F.coalesce("v.same_value", F.lit(False)), F.col("equal"), textual, F.col("old.trusted"))
    x = x.withColumns({"c": c, "canonical_name": F.col("old.canonical_name"), "value_kind": F.col("old.value_kind")})
    return _items(x, "canonical_name", "value_kind")


def cross_channels(facts: DataFrame, docs: DataFrame, ctx: RuleContext, resolution: Resolution) -> DataFrame:
    """Review items of number facts of one subject under different predicates that were not merged.

    Facts of one dimension meet by it. Those of two are only of interest where the units
    have forbidden a merge, so they meet by the predicates of a forbidden merge.
    """
    f = live_own(facts.where("object_type = 'number' and object_number is not null"), docs, ctx, resolution).withColumn("dim", X.normalize_dimension(F.col("measure_unit"))).where("dim is not null")
    bound = resolution.bindings.select("subject_id", "pred_fold", "canonical_key")
    f = f.join(bound, ["subject_id", "pred_fold"], "left")
    kept = [*CARRIED, "canonical_key", "dim"]
    apart = "not coalesce(old.canonical_key = new.canonical_key, false)"
    rejected = resolution.rejected.select("subject_id", "a", "b").distinct()
    near = _measured(detect.gated_pairs_sharing(f, None, ctx, "dim", kept).where(apart))
    split = rejected.select("subject_id", F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("split"))
    near = near.withColumns({"_a": F.least("old.pred_fold", "new.pred_fold"), "_b": F.greatest("old.pred_fold", "new.pred_fold")}).join(split, ["subject_id", "_a", "_b"], "left").drop("_a", "_b")
    far = _measured(detect.gated_pairs_of(f, None, ctx, rejected, kept).where(apart).where("old.dim <> new.dim"))
    x = near.unionByName(far.withColumn("split", F.lit(True)))
    return _items(x.withColumn("c", channel_cross_attribute(F.col("v.verdict"), F.col("v.same_value"), F.coalesce("split", F.lit(False)))))


def channels(facts: DataFrame, docs: DataFrame, ctx: RuleContext, resolution: Resolution) -> DataFrame:
    """All review items, each pair of facts once: merged pairs before unmerged ones."""
    null = F.lit(None).cast("string")
    same = same_predicate_channels(facts, docs, ctx, resolution).withColumns({"canonical_name": null, "value_kind": null})
    cross = cross_channels(facts, docs, ctx, resolution).withColumns({"canonical_name": null, "value_kind": null})
    return same.unionByName(merged_channels(facts, docs, ctx, resolution)).unionByName(cross)


def channel_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(F.count("*").alias("n"))


def restated_synonyms(facts: DataFrame, docs: DataFrame, resolution: Resolution) -> DataFrame:
    """``(fact_id)`` of facts in replaced documents that the newest edition states in other words.

    Only trusted text attributes count, under another predicate of the same attribute, with
    an equal value or one that is said to mean the same.
    """
    head = newest(docs)
    words = _whole(facts).where(F.col("object_type").isin("string", "boolean"))
    bound = words.join(resolution.bindings.where(F.col("value_kind").isin(*TEXT_KINDS)), ["subject_id", "pred_fold"])
    old = bound.join(resolution.facts.select("fact_id").distinct(), "fact_id", "left_semi").where("trusted").join(head.where("doc_id <> head_id"), "doc_id")
    old = old.select("subject_id", "canonical_key", "head_id", "fact_id", F.struct("pred_fold", "canon_object", "object_string").alias("o"))
    new = words.join(resolution.bindings, ["subject_id", "pred_fold"]).select("subject_id", "canonical_key", F.col("doc_id").alias("head_id"), F.struct("pred_fold", "canon_object", "object_string").alias("n"))
    pairs = old.join(new, ["subject_id", "canonical_key", "head_id"]).where("o.pred_fold <> n.pred_fold")
    pairs = texts_equivalent(pairs, resolution.texts, F.col("o.object_string"), F.col("n.object_string"))
    return pairs.where("o.canon_object = n.canon_object or texts_equivalent").select("fact_id").distinct()


def newest(docs: DataFrame) -> DataFrame:
    """``(doc_id, head_id)``: where the first declared successors lead to; cycles lead nowhere and are left out."""
    return versions.ends(versions.successors(docs).select("doc_id", "new_id"), docs.select("doc_id"))
