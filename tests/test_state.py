"""From a provider's answers to the knowledge that detectors read."""

from __future__ import annotations

from datetime import date

import pytest

from factloom.operators import detect, extract, provider, state
from factloom.rules import RuleContext
from factloom.session import stored


def test_retries_end():
    waited: list[float] = []
    answers = iter([RuntimeError("503 unavailable"), TimeoutError("timed out"), {"ok": 1}])

    def call():
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert provider.with_retries(call, sleep=waited.append) == ({"ok": 1}, 3) and waited == [5.0, 15.0]
    for failures, tries in ((["401 denied"], 1), (["try again"] * 9, 3)):
        left = iter(failures)
        waited.clear()
        with pytest.raises(RuntimeError):
            provider.with_retries(lambda: (_ for _ in ()).throw(RuntimeError(next(left))), sleep=waited.append)
        assert len(waited) == tries - 1
    with pytest.raises(ValueError):
        provider.with_retries(call, attempts=0)


def answer(text: str) -> dict:
    if "bad" in text:
        raise RuntimeError("401 denied")
    fact = {"subject": "Plan", "predicate": "price", "object_value": 5 if "old" in text else 6.0, "object_type": "number", "quote": text, "confidence": 0.9}
    return {"entities": [{"name": "Plan", "type": "product", "aliases": ["P"]}], "facts": [fact, {**fact, "predicate": "open", "object_value": True, "object_type": "boolean"}]}


def test_from_chunks_to_conflicts(spark):
    chunks = spark.createDataFrame([("c1", "d1", "old price"), ("c2", "d2", "new price"), ("c3", "d2", "bad chunk")], "chunk_id string, doc_id string, text string")
    entities, facts, failures = provider.extract(chunks, answer, waits=(0.0,))
    assert [(r.chunk_id, r.error) for r in failures.collect()] == [("c3", "RuntimeError: 401 denied")]
    done = extract.persist(entities, facts, chunks)
    assert done.rejected.count() == 0
    kept = stored(done.facts, "facts")
    documents = spark.createDataFrame([("d1", None, None, "a.md", None, 0.9, date(2026, 1, 1)), ("d2", None, None, "b.md", "policy", 0.8, None)], "doc_id string, group_id string, prev_id string, filename string, source_type string, authority double, parsed_at date")
    known = state.load(kept, done.entities, chunks, documents)
    assert {r.source_type for r in known.documents.collect()} == {"document", "policy"}
    assert {(r.subject_name, r.predicate, r.canon_object, r.doc_id) for r in known.facts.collect()} == {("Plan", "price", "scalar|number|5", "d1"), ("Plan", "price", "scalar|number|6", "d2"), ("Plan", "open", "scalar|boolean|true", "d1")}
    (found,) = detect.conflicts(known.facts, known.documents, RuleContext(as_of=date(2026, 6, 1))).collect()
    assert (found.predicate, found.severity, found.confidence) == ("price", "high", 0.8)


def test_what_is_loaded(spark):
    facts = spark.createDataFrame(
        [
            ("a", "e1", " price ", None, "5.0", "number", "c1", "active"), ("b", "e1", "led by", "e2", None, None, "c1", "active"), ("c", "e1", "by", "gone", None, None, "nowhere", "active"),
            ("d", "gone", "p", None, "x", "string", "c1", "active"), ("e", "e1", "p", None, "x", "string", "c1", "retracted"), ("f", "e1", "until", None, "2026-02-30", "date", "c2", None), ("g", "e1", "until", None, "2026-02-28", "date", "c2", "active"),
        ],
        "fact_id string, subject_id string, predicate string, object_entity_id string, object_value string, object_type string, chunk_id string, status string",
    )
    entities = spark.createDataFrame([("e1", "Plan"), ("e2", "Ann")], "entity_id string, name string")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "gone")], "chunk_id string, doc_id string")
    documents = spark.createDataFrame([("d1", "policy")], "doc_id string, source_type string")
    got = {r.fact_id: (r.predicate, r.object_entity_name, r.canon_object, r.doc_id) for r in state.load(facts, entities, chunks, documents).facts.collect()}
    assert got == {
        "a": ("price", None, "scalar|number|5", "d1"), "b": ("led by", "Ann", "entity|e2", "d1"), "c": ("by", None, "entity|gone", None),
        "f": ("until", None, "scalar|date|2026-02-30", None), "g": ("until", None, "scalar|date|2026-02-28", None),
    }
