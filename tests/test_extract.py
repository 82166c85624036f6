"""Candidate facts and entities: validation, references, review dates, and the whole way to facts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import extract

FACT = "chunk_id string, ord int, subject string, predicate string, object_entity string, object_value string, object_type string, json_type string, unit string, currency string, tax_basis string, valid_from string, valid_to string, observed_at string, quote string, confidence double"
ENTITY = "chunk_id string, ord int, name string, type string, aliases array<string>"


def facts(spark, *rows):
    names = [c.split()[0] for c in FACT.split(", ")]
    base = {"chunk_id": "c1", "subject": "Pro Plan", "predicate": "price", "object_value": "10", "object_type": "number", "quote": "costs 10", "confidence": 0.7}
    return spark.createDataFrame([tuple({**base, "ord": k, **r}.get(n) for n in names) for k, r in enumerate(rows)], FACT)


REJECTED = [
    ({}, None),
    ({"object_entity": "x", "object_value": None, "object_type": None}, None),
    ({"subject": " 　"}, "blank_subject"),
    ({"predicate": None}, "blank_predicate"),
    ({"quote": ""}, "blank_quote"),
    ({"object_entity": "x"}, "two_objects"),
    ({"object_value": None}, "no_object"),
    ({"object_entity": "x", "object_value": None}, "type_with_entity"),
    ({"object_type": None}, "type_missing"),
    ({"object_type": "money"}, "type_unknown"),
    ({"object_type": "string", "tax_basis": "unknown"}, "unit_without_number"),
    ({"tax_basis": "net"}, "tax_basis_unknown"),
    ({"currency": "EUR"}, "currency_without_unit"),
    ({"currency": "EUR", "unit": "EUR/month"}, None),
    ({"unit": " "}, "blank_measure"),
    ({"json_type": "string"}, "not_a_number"),
    ({"object_value": "ten"}, "not_a_number"),
    ({"object_type": "boolean", "object_value": "True"}, None),
    ({"object_type": "boolean", "object_value": "1"}, "not_a_boolean"),
    ({"object_type": "string", "json_type": "number"}, "not_a_string"),
    ({"object_type": "date", "object_value": "2026-13-45"}, "not_a_date"),
    ({"object_type": "date", "object_value": "2026-1-5"}, "not_a_date"),
    ({"object_type": "date", "object_value": "2026-02-28", "json_type": "string"}, None),
    ({"valid_to": "soon"}, "bad_window_date"),
    ({"observed_at": "2026-02-30"}, "bad_window_date"),
    ({"valid_from": "2026-02-02", "valid_to": "2026-02-01"}, "window_reversed"),
    ({"valid_from": "2026-02-02", "valid_to": "2026-02-02"}, None),
    ({"confidence": 1.5}, "confidence_out_of_range"),
]


def test_validation(spark):
    good, bad = extract.validated(facts(spark, *[r for r, _ in REJECTED]))
    assert {r.ord: r.reject_reason for r in bad.collect()} == {k: why for k, (_, why) in enumerate(REJECTED) if why}
    assert {r.ord for r in good.collect()} == {k for k, (_, why) in enumerate(REJECTED) if not why}


def test_review_dates(spark):
    day = {"object_type": "date", "object_value": "2026-03-01"}
    x = facts(
        spark,
        {"predicate": "Last Reviewed", **day}, {}, {"subject": " pro plan "}, {"subject": "Other"}, {"observed_at": "2020-01-01"}, {"chunk_id": "c2"},
        {"chunk_id": "c3", "predicate": "审核日期", **day}, {"chunk_id": "c3", "predicate": "reviewed", "object_type": "date", "object_value": "2026-03-02"}, {"chunk_id": "c3"},
        {"chunk_id": "c4", "predicate": "review of the effective date", **day}, {"chunk_id": "c4"}, {"chunk_id": "c5", "predicate": "updated", **day}, {"chunk_id": "c5"},
    )
    got = {r.ord: r.observed_at for r in extract.propagate_review_dates(x).collect()}
    assert got == {0: None, 1: "2026-03-01", 2: "2026-03-01", 3: None, 4: "2020-01-01", 5: None, 6: None, 7: None, 8: None, 9: None, 10: None, 11: None, 12: None}


@pytest.fixture
def world(spark):
    entities = spark.createDataFrame(
        [("c1", 0, "Pro  Plan", "product", ["PP"]), ("c2", 0, "pro plan", "Service", []), ("c2", 1, "Ann", "person", ["boss"]), ("c2", 2, "Bob", "person", ["boss"]), ("c2", 3, "Ann", "team", [])], ENTITY
    )
    chunks = spark.createDataFrame([("c1", "d1", "It costs 10 a month, until 2026/5/1."), ("c2", "d2", "  Led by Ann. It costs\n10 now.")], "chunk_id string, doc_id string, text string")
    return entities, chunks


def test_candidates_become_facts(spark, world):
    entities, chunks = world
    raw = facts(
        spark,
        {"quote": "It costs  10", "valid_to": "2026-05-01", "unit": " EUR ", "currency": "eur"},
        {"chunk_id": "c2", "subject": "pp", "quote": "costs 10", "predicate": " Price "},
        {"chunk_id": "c2", "subject": "pp", "quote": "not there", "predicate": "price"},
        {"chunk_id": "c2", "subject": "boss", "quote": "Ann"},
        {"chunk_id": "c2", "subject": "Pro Plan", "predicate": "led by", "object_entity": "Ann", "object_value": None, "object_type": None, "quote": "Led by Ann."},
        {"chunk_id": "c1", "subject": "Nobody", "object_type": "string", "object_value": " x ", "quote": "month"},
        {"chunk_id": "c1", "object_value": "ten"},
        {"chunk_id": "gone", "quote": "x"},
        {"chunk_id": "c1", "subject": "Ann", "quote": "month"},
    )
    done = extract.persist(entities, raw, chunks)
    got = {(r.predicate, r.canon_object, r.doc_id): r for r in done.facts.collect()}
    one = got["price", "scalar|number|10", "d1"]
    assert (one.valid_to_anchor, one.measure_unit, one.currency, one.evidence, one.quote_warning) == ("document_scope", "EUR", "EUR", "It costs  10", False)
    two = got["Price", "scalar|number|10", "d2"]
    # the same subject by name, type class and alias, in another edition of the fact: no end, so it is another fact
    assert two.subject_id == one.subject_id and two.fact_id != one.fact_id
    assert got["price", "scalar|number|10", "d2"].quote_warning and got["price", "scalar|number|10", "d2"].evidence.startswith("Led by Ann.")
    led = next(r for r in got.values() if r.predicate == "led by")
    assert led.canon_object == f"entity|{led.object_entity_id}" and led.subject_id == one.subject_id
    assert {(r.ord, r.reject_reason) for r in done.rejected.collect()} == {(3, "subject_ambiguous"), (6, "not_a_number"), (7, "no_evidence"), (8, "subject_ambiguous")}
    names = {r.name: r.entity_type for r in done.entities.collect()}
    assert names["Nobody"] == "unknown" and names["Pro  Plan"] == "product"
    again = extract.persist(entities, raw, chunks, done.facts)
    assert again.facts.count() == 0 and extract.pending_chunks(chunks, done.facts).count() == 0


def test_embeddings_are_filled(spark):
    things = spark.createDataFrame([(1, [1.0]), (2, None), (3, None)], "id long, embedding array<double>")
    vectors = spark.createDataFrame([(1, [9.0]), (2, [2.0]), (2, None)], "id long, embedding array<double>")
    assert {r.id: r.embedding for r in extract.fill_embeddings(things, vectors, "id").collect()} == {1: [1.0], 2: [2.0], 3: None}


def test_anchors_are_looked_for_in_the_chunk(spark):
    x = spark.createDataFrame([("c", "until 2026 . 5 . 1", "2026-05-01"), ("c", "none", "2026-05-01"), ("c", "none", "2026-06-01"), ("c", "none", None), ("gone", "none", "2026-05-01")], "chunk_id string, quote string, valid_to string").withColumn("valid_to", F.col("valid_to").cast("date"))
    chunks = spark.createDataFrame([("c", "ends on 2026年5月1日")], "chunk_id string, text string")
    assert sorted(str(r.valid_to_anchor) for r in extract.with_anchor(x, chunks).collect()) == ["None", "calendar_derived", "calendar_derived", "document_scope", "quoted"]
