"""The knowledge that detectors read, from stored facts, entities, chunks and documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X


@dataclass
class Knowledge:
    """Facts, documents and entities as the detectors take them."""

    facts: DataFrame
    documents: DataFrame
    entities: DataFrame


def load(facts: DataFrame, entities: DataFrame, chunks: DataFrame, documents: DataFrame) -> Knowledge:
    """Active facts with the names of their subject and object, and the document of their chunk.

    Facts of unknown subjects are left out; unknown objects, chunks and documents give
    nulls. Predicates are stripped, numbers without decimals are integers in the canonical
    form, dates that are none stay text, and documents without a type are of type document.
    """
    e = entities.select(F.col("entity_id").alias("_e"), F.col("name").alias("_n"))
    x = facts.where(F.coalesce("status", F.lit("active")) == "active") if "status" in facts.columns else facts
    x = x.join(e.select(F.col("_e").alias("subject_id"), F.col("_n").alias("subject_name")), "subject_id")
    x = x.join(e.select(F.col("_e").alias("object_entity_id"), F.col("_n").alias("object_entity_name")), "object_entity_id", "left")
    held = chunks.join(documents.select("doc_id"), "doc_id", "left_semi").select("chunk_id", F.col("doc_id").alias("_d"))
    x = x.drop("doc_id").join(held, "chunk_id", "left").withColumnRenamed("_d", "doc_id")
    x = x.withColumn("predicate", F.regexp_replace("predicate", r"(?U)^\s+|\s+$", ""))
    if "object_value" in x.columns:
        kind = F.col("object_type")
        typed = X.typed_objects(kind, F.col("object_value"))
        lost = (kind == "date") & typed["object_date"].isNull()
        x = x.withColumns({**typed, "object_string": F.when(lost, F.col("object_value")).otherwise(typed["object_string"])})
    objects = [F.col(c) for c in ("object_type", "object_string", "object_number", "object_date", "object_bool", "object_entity_id")]
    canon = F.coalesce(X.canonical_object(*objects), F.concat_ws("|", F.lit("scalar"), "object_type", "object_string"))
    x = x.withColumns({"pred_fold": X.fold(F.col("predicate")), "canon_object": canon})
    d = documents.withColumn("source_type", F.coalesce("source_type", F.lit("document")))
    return Knowledge(x, d, entities)
