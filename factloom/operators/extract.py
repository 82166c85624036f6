"""What happens to candidate facts and entities after extraction: evidence, anchors, dates, validation, identity.

Candidates come from a model or any other source as rows: entities ``(chunk_id, ord, name,
type, aliases)`` and facts ``(chunk_id, ord, subject, predicate, object_entity,
object_value, object_type, json_type, unit, currency, tax_basis, valid_from, valid_to,
observed_at, quote, confidence)``, values and dates as text. :func:`persist` takes them to
facts with evidence; what is refused comes back with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.rules import OFFERING_TYPES, REVIEW_EXCLUSIONS, REVIEW_MARKERS

#: Characters of a chunk that stand in for a quote which it does not hold; a fixed value.
EVIDENCE_CHARS = 500
UNKNOWN = "unknown"
WIRE = ["subject", "predicate", "object_entity", "object_value", "object_type", "json_type", "unit", "currency", "tax_basis", "valid_from", "valid_to", "observed_at", "quote", "confidence"]


def with_evidence(raw_facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with ``evidence``: their quote if the chunk supports it, else the chunk's beginning and a warning."""
    x = raw_facts.join(chunks.select("chunk_id", F.col("text").alias("_chunk")), "chunk_id", "left")
    good = X.quote_supported(F.col("_chunk"), F.col("quote"))
    begin = F.substring(F.regexp_replace("_chunk", r"(?U)^\s+|\s+$", ""), 1, EVIDENCE_CHARS)
    return x.withColumns({"evidence": F.when(good, F.regexp_replace("quote", r"(?U)^\s+|\s+$", "")).otherwise(begin), "quote_warning": ~good}).drop("_chunk")


def with_anchor(facts: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Facts with where the end of their window comes from: their quote, their chunk, or neither. Facts without an end read no chunk."""
    dated, undated = facts.where("valid_to is not null"), facts.where("valid_to is null")
    x = dated.join(chunks.select(id_col, F.col("text").alias("_text")), id_col, "left")
    x = x.withColumn("valid_to_anchor", X.classify_valid_to(F.col("quote"), F.col("_text"), F.col("valid_to"))).drop("_text")
    return x.unionByName(undated.withColumn("valid_to_anchor", F.lit(None).cast("string")))


def anchor_counts(facts: DataFrame) -> DataFrame:
    """``(valid_to_anchor, n, share)`` of facts with an end: a replay of how their ends are anchored."""
    x = facts.where("valid_to is not null").groupBy("valid_to_anchor").agg(F.count("*").alias("n"))
    total = x.agg(F.sum("n").alias("total"))
    return x.join(F.broadcast(total)).select("valid_to_anchor", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def is_review(predicate: Column, object_type: Column, markers: tuple[str, ...] = REVIEW_MARKERS, exclusions: tuple[str, ...] = REVIEW_EXCLUSIONS) -> Column:
    """Whether a fact dates the last review of its subject."""
    folded = F.lower(predicate)
    return F.coalesce((object_type == "date") & _holds(folded, markers) & ~_holds(folded, exclusions), F.lit(False))


def propagate_review_dates(facts: DataFrame, markers: tuple[str, ...] = REVIEW_MARKERS, exclusions: tuple[str, ...] = REVIEW_EXCLUSIONS) -> DataFrame:
    """Undated facts take the review date of their chunk and subject, if there is exactly one; review facts themselves stay undated."""
    review = is_review(F.col("predicate"), F.col("object_type"), markers, exclusions) & F.col("object_value").isNotNull()
    x = facts.withColumns({"_s": X.fold(F.col("subject")), "_r": review})
    dates = x.where("_r").groupBy("chunk_id", "_s").agg(F.min("object_value").alias("lo"), F.max("object_value").alias("hi")).where("lo = hi").select("chunk_id", "_s", F.col("lo").alias("_d"))
    x = x.join(dates, ["chunk_id", "_s"], "left")
    fill = F.when(F.col("observed_at").isNull() & ~F.col("_r"), F.col("_d").cast(facts.schema["observed_at"].dataType)).otherwise(F.col("observed_at"))
    return x.withColumn("observed_at", fill).select(*facts.columns)


def validated(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid facts, and rejected ones with ``reject_reason``; columns that a frame lacks count as null."""
    null = F.lit(None).cast("string")
    x = facts.withColumn("reject_reason", X.reject_reason({n: F.col(n) if n in facts.columns else null.cast("double") if n == "confidence" else null for n in WIRE}))
    return x.where("reject_reason is null").drop("reject_reason"), x.where("reject_reason is not null")


def new_facts(facts: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Facts whose key is not known, once each; nulls in a key are equal."""
    hashed = F.xxhash64(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    seen = known.select(hashed.alias("_k")).distinct()
    return facts.withColumn("_k", hashed).join(seen, "_k", "left_anti").drop("_k").dropDuplicates(key)


def pending_chunks(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunks that no fact comes from."""
    return chunks.join(facts.select("chunk_id").distinct(), "chunk_id", "left_anti")


def type_class(entity_type: Column) -> Column:
    """The class of a type label: offerings are one, every other label its own."""
    folded = X.fold(entity_type)
    return F.when(folded.isin(*OFFERING_TYPES), "offering").otherwise(folded)


def resolve_entities(raw: DataFrame) -> DataFrame:
    """``raw`` with ``entity_id``: one entity for each folded name and class of equivalent types, named by its first mention.

    First is by ``chunk_id`` and ``ord``, so the order of rows does not matter.
    """
    x = raw.withColumns({"name_fold": X.normalize_entity_name(F.col("name")), "class": type_class(F.col("type"))})
    first = x.groupBy("name_fold", "class").agg(F.min_by(F.struct("name", "type"), F.struct("chunk_id", "ord")).alias("f"))
    first = first.select("name_fold", "class", F.sha2(F.concat_ws("|", "name_fold", "class"), 256).alias("entity_id"), F.col("f.name").alias("canonical_name"), F.col("f.type").alias("entity_type"))
    return x.join(first, ["name_fold", "class"]).drop("name_fold", "class")


def alias_index(resolved: DataFrame) -> DataFrame:
    """``(alias_fold, entity_id)``: names and aliases of the entities of :func:`resolve_entities`, each once."""
    own = resolved.select(X.normalize_entity_name(F.col("name")).alias("alias_fold"), "entity_id")
    if "aliases" in resolved.columns:
        own = own.unionAll(resolved.select(F.explode("aliases").alias("a"), "entity_id").select(X.normalize_entity_name(F.col("a")), "entity_id"))
    return own.where("alias_fold <> ''").distinct()


def resolve_references(facts: DataFrame, resolved: DataFrame, col: str = "subject") -> DataFrame:
    """``facts`` with ``{col}_id`` and ``{col}_kind`` for the entity that a column names.

    ``declared``: the fact's own chunk declares the name, and its first declaration counts.
    Otherwise all names and aliases are looked up: one entity is ``matched``, several are
    ``ambiguous`` and give no id, none makes an entity of type unknown. Null stays null.
    """
    fold = X.normalize_entity_name(F.col(col))
    declared = resolved.groupBy("chunk_id", X.normalize_entity_name(F.col("name")).alias("_n")).agg(F.min_by("entity_id", "ord").alias("_declared"))
    index = alias_index(resolved).groupBy(F.col("alias_fold").alias("_n")).agg(F.min("entity_id").alias("_one"), F.count("*").alias("_c"))
    x = facts.withColumn("_n", fold).join(declared, ["chunk_id", "_n"], "left").join(index, "_n", "left")
    kind = F.when(F.col("_n").isNull(), None).when(F.col("_declared").isNotNull(), "declared").when(F.col("_c") == 1, "matched").when(F.col("_c") > 1, "ambiguous").otherwise(UNKNOWN)
    made = F.sha2(F.concat_ws("|", "_n", F.lit(UNKNOWN)), 256)
    x = x.withColumn(f"{col}_kind", kind)
    found = F.coalesce("_declared", F.when(F.col(f"{col}_kind") == "matched", F.col("_one")).when(F.col(f"{col}_kind") == UNKNOWN, made))
    return x.withColumn(f"{col}_id", found).drop("_n", "_declared", "_one", "_c")


@dataclass
class Persisted:
    """Facts that were taken, refused candidates with ``reject_reason``, and the entities that facts refer to."""

    facts: DataFrame
    rejected: DataFrame
    entities: DataFrame


FACT_KEY = ["subject_id", "predicate", "object_entity_id", "object_type", "canon_object", "valid_from", "valid_to"]


def persist(raw_entities: DataFrame, raw_facts: DataFrame, chunks: DataFrame, known: DataFrame | None = None) -> Persisted:
    """Candidates of chunks ``(chunk_id, doc_id, text)`` as facts with evidence, anchors and entities; known facts are left out.

    Review dates come first, as they date other facts of a chunk; then validation, anchors,
    references, evidence and the fact key.
    """
    resolved = resolve_entities(raw_entities)
    good, bad = validated(propagate_review_dates(raw_facts))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    dates = {c: X.normalize_date(F.col(c)) for c in ("valid_from", "valid_to", "observed_at")}
    x = good.withColumns({**dates, **X.typed_objects(F.col("object_type"), F.col("object_value")), "predicate": strip(F.col("predicate")), "measure_unit": strip(F.col("unit")), "currency": F.upper(strip(F.col("currency")))})
    x = with_anchor(x, chunks)
    x = resolve_references(resolve_references(x, resolved), resolved, "object_entity")
    lost = F.when(F.col("subject_kind") == "ambiguous", "subject_ambiguous").when(F.col("object_entity_kind") == "ambiguous", "object_ambiguous")
    x = with_evidence(x.withColumn("reject_reason", lost), chunks)
    x = x.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.coalesce("evidence", F.lit("")) == "", "no_evidence")))
    typed = [F.col(c) for c in ("object_type", "object_string", "object_number", "object_date", "object_bool", "object_entity_id")]
    x = x.withColumns({"canon_object": X.canonical_object(*typed), "pred_fold": X.fold(F.col("predicate"))})
    kept = x.where("reject_reason is null").join(chunks.select("chunk_id", "doc_id"), "chunk_id", "left")
    fact_id = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in FACT_KEY])), 256)
    columns = [
        "fact_id", "subject_id", "predicate", "pred_fold", "object_type", "object_string", "object_number", "object_date", "object_bool", "object_entity_id", "canon_object", "measure_unit", "currency", "tax_basis",
        "valid_from", "valid_to", "valid_to_anchor", "observed_at", "confidence", "doc_id", "chunk_id", "evidence", "quote_warning",
    ]
    first = kept.withColumn("fact_id", fact_id).groupBy("fact_id").agg(F.min_by(F.struct(*[F.col(c) for c in kept.columns]), F.struct("chunk_id", "ord")).alias("f")).select("fact_id", "f.*").select(*columns)
    if known is not None:
        first = first.join(known.select("fact_id").distinct(), "fact_id", "left_anti")
    refused = bad.select(*raw_facts.columns, "reject_reason").unionByName(x.where("reject_reason is not null").select("chunk_id", "ord", "reject_reason").join(raw_facts, ["chunk_id", "ord"]).select(*raw_facts.columns, "reject_reason"))
    declared = resolved.select("entity_id", F.col("canonical_name").alias("name"), "entity_type")
    salvaged = x.where(F.col("subject_kind") == UNKNOWN).select(F.col("subject_id").alias("entity_id"), F.col("subject").alias("name"))
    salvaged = salvaged.unionAll(x.where(F.col("object_entity_kind") == UNKNOWN).select("object_entity_id", "object_entity"))
    entities = declared.unionByName(salvaged.withColumn("entity_type", F.lit(UNKNOWN))).groupBy("entity_id").agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"))
    return Persisted(first, refused, entities)


def fill_embeddings(things: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """``things`` with missing embeddings taken from ``vectors`` ``(key, embedding)``; what neither has stays null."""
    v = vectors.groupBy(key).agg(F.first("embedding", ignorenulls=True).alias("_e"))
    x = things.join(v, key, "left")
    return x.withColumn("embedding", F.coalesce("embedding", "_e")).drop("_e")
