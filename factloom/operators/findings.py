"""All detectors as one table of findings, and what a finding says for people: names, files, values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import attributes, detect
from factloom.rules import CONFIDENCE_STRUCTURAL, RuleContext

#: Columns of a finding; ids are text.
COLUMNS = {
    "detector_type": "string",
    "drift_type": "string",
    "target_type": "string",
    "target_id": "string",
    "severity": "string",
    "ai_impact_level": "string",
    "confidence": "double",
    "subject_id": "string",
    "predicate": "string",
    "old_fact_id": "string",
    "new_fact_id": "string",
    "old_document_id": "string",
    "new_document_id": "string",
    "effective_at": "timestamp",
    "reason": "string",
    "extra": "map<string,string>",
    "fingerprint": "string",
}


def _as_findings(frame: DataFrame, detector: str, **columns: Column) -> DataFrame:
    given = {"detector_type": F.lit(detector), "ai_impact_level": X.ai_impact(F.col("severity")), **columns}
    out = []
    for name, kind in COLUMNS.items():
        value = given.get(name, F.col(name) if name in frame.columns else F.lit(None))
        out.append(value.cast(kind).alias(name))
    return frame.select(*out)


def _extra(**values: Column) -> Column:
    return F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("string"))])


def detect_all(facts: DataFrame, docs: DataFrame, entities: DataFrame, ctx: RuleContext, entity_facts: DataFrame | None = None, least_cosine: float = 0.85, resolution: attributes.Resolution | None = None) -> DataFrame:
    """The findings of all detectors in the columns of ``COLUMNS``.

    ``entity_facts`` are the facts that duplicates are looked for in, by default all of them.
    With a ``resolution`` of attributes, pairs that it clears are no conflicts, and facts
    that the newest edition states in other words are not stale for being replaced.
    """
    if resolution is None:
        conflict, stale = detect.conflicts(facts, docs, ctx), detect.stale(facts, docs, ctx)
    else:
        conflict = attributes.conflicts(facts, docs, ctx, resolution)
        stale = detect.stale(facts, docs, ctx, attributes.restated_synonyms(facts, docs, resolution))
    cards, reused, replaced = detect.expired_documents(facts, docs, ctx), detect.reused_values(facts, docs, ctx), detect.superseded(docs, ctx)
    twins = detect.duplicate_facts(entities, facts if entity_facts is None else entity_facts, docs, least_cosine)
    fact, document = F.lit("fact"), F.lit("document")
    sure = F.lit(CONFIDENCE_STRUCTURAL)
    parts = [
        _as_findings(conflict, "conflict", target_type=fact, target_id=F.col("old_fact_id"), reason=F.lit("overlapping_validity_different_objects"), extra=_extra(old_value=F.col("old_value"), new_value=F.col("new_value"))),
        _as_findings(stale, "stale", target_type=fact, target_id=F.col("fact_id"), old_fact_id=F.col("fact_id"), old_document_id=F.col("doc_id"), extra=_extra(valid_to=F.col("valid_to"), valid_to_anchor=F.col("valid_to_anchor"), age_days=F.col("age_days"))),
        _as_findings(cards, "stale", target_type=document, target_id=F.col("doc_id"), old_fact_id=F.col("fact_id"), old_document_id=F.col("doc_id"), confidence=sure, reason=F.lit("document_self_declared_expired"), extra=_extra(valid_to=F.col("valid_to"), valid_to_anchor=F.col("valid_to_anchor"))),
        _as_findings(reused, "stale", target_type=fact, target_id=F.col("fact_id"), old_fact_id=F.col("fact_id"), confidence=sure, reason=F.lit("reused_superseded_value"), extra=_extra(reused_value=X.number_text(F.col("reused_value")), head_value=X.number_text(F.col("head_value")), unit=F.col("measure_unit"), source_id=F.col("doc_id"))),
        _as_findings(replaced, "superseded", target_type=document, target_id=F.col("old_document_id"), reason=F.lit("explicit_version_replacement"), extra=_extra(group_id=F.col("group_id"))),
        _as_findings(twins, "duplicate", target_type=fact, target_id=F.col("old_fact_id"), predicate=F.col("pred_fold"), reason=F.lit("unmerged_entities_same_fact"), extra=_extra(recall=F.col("recall"), shared_fact_count=F.col("shared"), entity_a=F.col("a"), entity_b=F.col("b"), object=F.col("canon_object"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_context(found: DataFrame, docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Findings with ``subject`` and the file names ``source``, ``old_source`` and ``new_source``; dangling ids give nulls.

    ``old_source`` is the file that a finding is about: the replaced edition, else the fact's own.
    """
    files = docs.select(F.col("doc_id").cast("string").alias("_d"), F.col("filename").alias("_f"))
    x = found.withColumn("_own", F.coalesce(F.col("extra")["source_id"], F.when(F.col("drift_type") != "conflict", F.col("old_document_id"))))
    for id_col, name in (("old_document_id", "old_source"), ("new_document_id", "new_source"), ("_own", "source")):
        x = x.join(files.withColumnsRenamed({"_d": id_col, "_f": name}), id_col, "left")
    names = entities.select(F.col("entity_id").cast("string").alias("subject_id"), F.col("name").alias("subject"))
    return x.join(names, "subject_id", "left").drop("_own")


def with_detail(found: DataFrame) -> DataFrame:
    """Findings of :func:`with_context` with ``detail``: reason, names, files and values as JSON; what does not apply is left out."""
    named = F.create_map(*[x for n in ("reason", "subject", "predicate", "source", "old_source", "new_source") for x in (F.lit(n), F.col(n))])
    whole = F.map_filter(F.map_concat(named, F.map_filter("extra", lambda k, v: k != "source_id")), lambda k, v: v.isNotNull())
    entries = F.array_sort(F.map_entries(whole))
    return found.withColumn("detail", F.to_json(F.map_from_entries(entries))).drop("extra")
