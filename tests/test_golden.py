"""Scenarios of our own for every finding type, with benign and ambiguous counterparts."""

from __future__ import annotations

from datetime import date

import pytest

from factloom.operators import evaluate, golden, report
from factloom.rules import DRIFT_TYPES


def case(name, facts=(), docs=(), expected=(), things=("p",), category=None, **more):
    """A whole case from what matters in it: documents have their id as file name, entities as name."""
    kinds = {bool: "boolean", int: "number", float: "number", date: "date"}
    things = [t if isinstance(t, dict) else {"id": t} for t in things]
    full = []
    for k, f in enumerate(facts):
        f = {"id": f"f{k}", "subject": "p", "predicate": "fee", **f}
        f["value_type"] = f.get("value_type") or ("entity" if "object_entity" in f else kinds.get(type(f.get("value")), "string"))
        full.append(f)
    return {
        "id": name, "title": name, "category": category or ("positive" if expected else "negative"), "documents": [{"filename": d["id"], **d} for d in docs], "entities": [{"name": t["id"], **t} for t in things],
        "facts": full, "expected_drifts": list(expected), **more,
    }


A, B = {"id": "a"}, {"id": "b"}
PRICES = [{"id": "a", "source_type": "pricing"}, {"id": "b", "source_type": "pricing"}]
V1, V2, V3 = {"id": "v1", "group": "g"}, {"id": "v2", "group": "g", "previous_version_of": "v1"}, {"id": "v3", "group": "g", "previous_version_of": "v2"}
PAST = date(2026, 5, 1)

CASES = [
    case("numbers disagree", [{"value": 31, "source": "a"}, {"value": 37, "source": "b"}], [A, B], [{"type": "conflict", "severity": "high", "subject": "p", "predicate": "FEE"}]),
    case("words disagree", [{"value": "net 30", "source": "a"}, {"value": "net 60", "source": "b"}], [A, B], [{"type": "conflict"}]),
    case("override", [{"value": 1, "source": "a"}, {"value": 2, "source": "b"}], PRICES, [{"type": "conflict", "severity": "critical"}], rules={"severity": {"pricing_change": "critical"}}),
    case("entities disagree", [{"object_entity": "x", "source": "a"}, {"object_entity": "y", "source": "b"}], [A, B], [{"type": "conflict"}], things=("p", "x", "y")),
    case("tiers of one document", [{"value": 31, "source": "a"}, {"value": 37, "source": "a"}], [A]),
    case("same number, other type", [{"value": 149, "source": "a"}, {"value": 149.0, "source": "b"}], [A, B], category="ambiguous_negative"),
    case("same words, other spaces", [{"value": "net 30", "source": "a"}, {"value": "  net 30 ", "source": "b"}], [A, B], category="ambiguous_negative"),
    case("one after the other", [{"value": 1, "source": "a", "valid_to": date(2026, 12, 31)}, {"value": 2, "source": "b", "valid_from": date(2027, 1, 1)}], [A, B]),
    case("several allowed", [{"value": "x", "source": "a"}, {"value": "y", "source": "b"}], [A, B], category="ambiguous_negative", rules={"multi_valued_predicates": [" FEE "]}),
    case("ended by its own words", [{"value": 1, "source": "a", "valid_to": PAST, "valid_to_anchor": "quoted"}], [A], [{"type": "confirmed_stale", "severity": "medium", "old_source": "a"}]),
    case("ended, source replaced", [{"value": 1, "source": "v1", "valid_to": PAST}], [V1, V2], [{"type": "confirmed_stale", "new_source": "v2"}, {"type": "superseded", "target": "document", "old_source": "v1"}]),
    case("ends today", [{"value": 1, "source": "a", "valid_to": date(2026, 6, 1)}], [A]),
    case("end only inferred", [{"value": 1, "source": "a", "valid_to": PAST, "valid_to_anchor": "calendar_derived"}], [A], [{"type": "possibly_stale", "severity": "warning"}]),
    case("seen long ago", [{"value": 1, "source": "a", "observed_at": date(2024, 1, 1)}], [A], [{"type": "possibly_stale"}]),
    case("prices age faster", [{"value": 1, "source": "a", "observed_at": date(2026, 1, 1)}], PRICES, [{"type": "possibly_stale"}], rules={"pricing_stale_days": 90}),
    case("newest edition", [{"value": 1, "source": "v2", "observed_at": date(2020, 1, 1)}], [{**V1}, V2], [{"type": "superseded"}]),
    case("this year's rate", [{"value": 1, "source": "a", "valid_from": date(2026, 1, 1)}], PRICES, category="ambiguous_negative", rules={"pricing_stale_days": 90}),
    case("metadata is silent", [{"value": "2019", "source": "a", "valid_to": PAST}], [A], rules={"immutable_metadata_predicates": ["Fee"]}),
    case("three editions", [], [V1, V2, V3], [{"type": "superseded", "old_source": "v1", "new_source": "v2"}, {"type": "superseded", "old_source": "v2", "new_source": "v3"}], things=()),
    case("a group without an edge", [], [{"id": "x", "group": "g"}, {"id": "y", "group": "g"}], category="ambiguous_negative", things=()),
    case("a number that was given up", [{"value": 70, "measure_unit": "CNY", "source": "v1"}, {"value": 80, "measure_unit": "CNY", "source": "v2"}, {"value": 70, "measure_unit": "CNY", "source": "a", "predicate": "channel fee"}], [V1, V2, A], [{"type": "reused_stale_value", "severity": "high", "old_source": "v1", "new_source": "v2"}, {"type": "confirmed_stale"}, {"type": "superseded"}]),
    case("number never changed", [{"value": 5, "measure_unit": "d", "source": "v1"}, {"value": 5, "measure_unit": "d", "source": "v2"}, {"value": 5, "measure_unit": "d", "source": "a", "predicate": "other"}], [V1, V2, A], [{"type": "confirmed_stale"}, {"type": "superseded"}]),
    case("document ends itself", [{"predicate": "有效期至", "value": PAST, "source": "a", "valid_to": PAST, "valid_to_anchor": "quoted"}], [A], [{"type": "confirmed_stale", "target": "document", "old_source": "a", "predicate": "有效期至"}]),
    case("document will end", [{"predicate": "有效期至", "value": date(2026, 9, 1), "source": "a", "valid_to": date(2026, 9, 1), "valid_to_anchor": "quoted"}], [A]),
    case("one thing twice", [{"value": "k1", "predicate": "code", "source": "a"}, {"value": "k1", "predicate": "code", "source": "b", "subject": "q"}], [A, B], [{"type": "duplicate", "severity": "warning"}], things=({"id": "p", "name": "Pro Plan"}, {"id": "q", "name": "pro  plan"})),
    case("found by vector", [{"value": "k1", "predicate": "code"}, {"value": "k1", "predicate": "code", "subject": "q"}], [], [{"type": "duplicate"}], things=({"id": "p", "name": "Alpha", "embedding": [1.0, 0.5]}, {"id": "q", "name": "Omega", "embedding": [1.0, 0.5]})),
    case("names alone", [{"value": "k1", "predicate": "code"}, {"value": "k2", "predicate": "code", "subject": "q"}], [], things=({"id": "p", "name": "Pro Plan"}, {"id": "q", "name": "Pro Plan"})),
    case("a generic fact", [{"value": "yes", "predicate": "ok"}, {"value": "yes", "predicate": "ok", "subject": "q"}, {"value": "yes", "predicate": "ok", "subject": "r"}], [], things=({"id": "p", "name": "Pro Plan"}, {"id": "q", "name": "Pro Plan X"}, {"id": "r", "name": "Pro Plan Y"})),
    case("metadata by default", [{"predicate": "版本", "value": "v3", "source": "a", "valid_to": PAST}], [A]),
    case("a statement in its own words", [{"predicate": "失效日期", "value": "2026-05-01", "source": "a", "valid_to": PAST}, {"value": 3, "source": "a", "valid_to": PAST, "valid_to_anchor": "document_scope"}], [A], [{"type": "confirmed_stale", "target": "document"}, {"type": "possibly_stale", "target": "fact", "predicate": "fee"}]),
    case("a statement that is only inferred", [{"predicate": "到期日期", "value": PAST, "source": "a", "valid_to": PAST, "valid_to_anchor": "document_scope"}], [A], [{"type": "possibly_stale", "target": "fact"}]),
    case("an ended document that is replaced", [{"predicate": "有效期截止", "value": PAST, "source": "v1", "valid_to": PAST}], [V1, V2], [{"type": "superseded", "target": "document"}]),
    case("ended documents repeat nothing", [{"value": 70, "measure_unit": "kg", "source": "v1"}, {"value": 80, "measure_unit": "kg", "source": "v2"}, {"value": 70, "measure_unit": "kg", "source": "a", "predicate": "load"}, {"predicate": "失效日期", "value": PAST, "source": "a", "valid_to": PAST}], [V1, V2, A], [{"type": "confirmed_stale", "target": "document", "old_source": "a"}, {"type": "confirmed_stale", "target": "fact", "old_source": "v1", "new_source": "v2"}, {"type": "superseded"}]),
    case("two editions back", [{"value": 70, "measure_unit": "kg", "source": "v1"}, {"value": 75, "measure_unit": "kg", "source": "v2"}, {"value": 80, "measure_unit": "kg", "source": "v3"}, {"value": 70, "measure_unit": " KG", "source": "a", "predicate": "load"}], [V1, V2, V3, A], [{"type": "reused_stale_value", "old_source": "v1", "new_source": "v3", "predicate": "load"}, {"type": "confirmed_stale", "old_source": "v1"}, {"type": "confirmed_stale", "old_source": "v2"}, {"type": "superseded"}, {"type": "superseded"}]),
    case("editions of one handbook", [{"value": "k1", "predicate": "code", "source": "v1"}, {"value": "k1", "predicate": "code", "source": "v3", "subject": "q"}], [V1, V2, V3], [{"type": "confirmed_stale", "predicate": "code"}, {"type": "superseded"}, {"type": "superseded"}], things=({"id": "p", "name": "Guide"}, {"id": "q", "name": "guide"})),
    case("two facts in common", [{"value": "k1", "predicate": "code"}, {"value": "k1", "predicate": "code", "subject": "q"}, {"value": 4, "predicate": "size"}, {"value": 4.0, "predicate": "Size", "subject": "q"}], [], [{"type": "duplicate", "predicate": "code", "subject": "p"}, {"type": "duplicate", "predicate": "size"}], things=({"id": "p", "name": "Pro Plan"}, {"id": "q", "name": "Pro Plan"})),
    case("a name within another", [{"value": "k1", "predicate": "code"}, {"value": "k1", "predicate": "code", "subject": "q"}], [], [{"type": "duplicate"}], things=({"id": "p", "name": "Pro Plan"}, {"id": "q", "name": "Pro-Plan (EU)"})),
    case("a short name within another", [{"value": "k1", "predicate": "code"}, {"value": "k1", "predicate": "code", "subject": "q"}], [], category="ambiguous_negative", things=({"id": "p", "name": "ab"}, {"id": "q", "name": "ab cd ef"})),
    case("one after the other again", [{"value": "k1", "predicate": "code", "valid_to": date(2026, 12, 31)}, {"value": "k1", "predicate": "code", "subject": "q", "valid_from": date(2027, 1, 1)}], [], things=({"id": "p", "name": "Pro Plan"}, {"id": "q", "name": "Pro Plan"})),
    case("a thing and its name", [{"object_entity": "r", "predicate": "owner"}, {"value": "r", "predicate": "owner", "subject": "q"}], [], category="ambiguous_negative", things=({"id": "p", "name": "Pro Plan"}, {"id": "q", "name": "Pro Plan"}, {"id": "r", "name": "r"})),
    case("one owner of two", [{"object_entity": "r", "predicate": "owner"}, {"object_entity": "r", "predicate": "owner", "subject": "q"}], [], [{"type": "duplicate"}], things=({"id": "p", "name": "Pro Plan"}, {"id": "q", "name": "Pro Plan"}, {"id": "r", "name": "someone"})),
    case("a true and a false", [{"value": True, "source": "a"}, {"value": False, "source": "b"}], [A, B], [{"type": "conflict"}]),
    case("two days", [{"value": date(2027, 1, 1), "source": "a"}, {"value": "2027-01-02", "value_type": "date", "source": "b"}], [A, B], [{"type": "conflict"}]),
]


def test_all_scenarios_pass_the_gate(spark):
    suite = golden.run_suite(spark, CASES)
    told = [r.asDict() for r in suite.missed.unionByName(suite.unexpected.drop("finding_id"), allowMissingColumns=True).collect()]
    assert not [r.case_id for r in suite.cases.where("not passed").collect()], told
    row = suite.total.first()
    assert row.passed and row.tp == sum(len(c["expected_drifts"]) for c in CASES) and (row.fp, row.fn) == (0, 0)
    result = report.evaluation(suite)
    assert {t["drift_type"] for t in result["by_type"]} == set(DRIFT_TYPES) and not result["failed"]
    assert "gate passed" in report.evaluation_text(result) and "| conflict |" in report.evaluation_markdown(result)


def test_what_is_missed_and_what_is_not_expected_is_told(spark):
    wrong = case("wrong", [{"value": 1, "source": "a"}, {"value": 2, "source": "b"}], [A, B], [{"type": "conflict", "severity": "critical"}])
    quiet = case("quiet", [{"value": 1, "source": "a"}], [A])
    suite = golden.run_suite(spark, [wrong, quiet])
    result = report.evaluation(suite)
    assert [f["case_id"] for f in result["failed"]] == ["wrong"] and not result["total"]["passed"]
    assert (len(result["missed"]), len(result["unexpected"])) == (1, 1) and "not expected wrong: conflict" in report.evaluation_text(result)
    # without benign cases, or without any, the gate does not pass
    assert not golden.run_suite(spark, CASES[:2]).total.first().passed


def test_specific_expectations_come_first(spark):
    e = "case_id string, expected_id string, drift_type string, " + ", ".join(f"{n} string" for n in evaluate.LOCATORS)
    f = golden.FOUND
    wanted = spark.createDataFrame([("c", "0000", "conflict", None, None, None, None, None, None), ("c", "0001", "conflict", None, "FEE", "high", None, None, None), ("c", "0002", "conflict", None, None, None, None, None, "document")], e)
    found = spark.createDataFrame([("c", "x", "conflict", None, "fee", "high", None, None, "fact"), ("c", "y", "conflict", None, "tax", "high", None, None, "fact")], f)
    got = {r.expected_id: r.finding_id for r in evaluate.match_findings(wanted, found).collect()}
    assert got == {"0000": "y", "0001": "x", "0002": None}


@pytest.mark.parametrize(
    "bad",
    [
        {"category": "odd"}, {"category": "positive"}, {"title": ""}, {"extra": 1}, {"as_of": "today"}, {"rules": {"stale_after_days": 0}}, {"rules": {"severity": {"x": "huge"}}},
        {"documents": [{"id": "x", "filename": "x", "previous_version_of": "gone"}]}, {"documents": [{"id": "x", "filename": "x", "previous_version_of": "x"}]}, {"documents": [{"id": "x"}]}, {"documents": [{"id": "x", "filename": "x", "authority": 2}]},
        {"facts": [{"id": "f", "subject": "gone", "predicate": "x", "value": 1}]}, {"facts": [{"id": "f", "subject": "p", "predicate": "x"}]}, {"facts": [{"id": "f", "subject": "p", "predicate": "x", "value": 1, "object_entity": "p"}]},
        {"facts": [{"id": "f", "subject": "p", "predicate": "x", "value_type": "entity", "object_entity": "gone"}]}, {"facts": [{"id": "f", "subject": "p", "predicate": "x", "value": 1, "valid_to_anchor": "guessed"}]},
    ],
)
def test_bad_cases_are_refused(bad):
    with pytest.raises(ValueError):
        golden.check_case({**case("x"), **bad})
    with pytest.raises(ValueError):
        golden.check_cases([case("x"), case("x")])


YAML = """
cases:
  - id: prices
    title: two prices
    category: positive
    rules: {severity: {pricing_change: critical}}
    documents:
      - {id: a, filename: a.csv, source_type: pricing}
      - {id: b, filename: b.csv}
    entities: [{id: p, name: Plan, embedding: [1, 0.5]}]
    facts:
      - {id: x, subject: p, predicate: price, value: 5, value_type: number, source: a, valid_from: 2026-01-05}
      - {id: y, subject: p, predicate: price, value: 6, value_type: number, source: b}
    expected_drifts: [{type: conflict, severity: critical, old_source: a.csv, new_source: b.csv}]
"""


def test_cases_are_read_from_files(spark, tmp_path):
    (tmp_path / "b.yml").write_text(YAML)
    (tmp_path / "a.yaml").write_text(YAML.replace("prices", "others").replace("critical, old", "high, old").replace("severity: {pricing_change: critical}", "pricing_stale_days: 1000"))
    (tmp_path / "notes.txt").write_text("no case")
    cases = golden.load_cases(tmp_path)
    assert [c["id"] for c in cases] == ["others", "prices"] and cases[1]["facts"][0]["valid_from"] == date(2026, 1, 5)
    assert golden.run_suite(spark, cases).cases.where("passed").count() == 2
    (tmp_path / "c.yaml").write_text(YAML)
    with pytest.raises(ValueError, match="twice"):
        golden.load_cases(tmp_path)
    for text in ("cases: []", "cases: [", "other: 1", YAML + "    surprise: 1\n"):
        (tmp_path / "c.yaml").write_text(text)
        with pytest.raises(ValueError):
            golden.load_cases(tmp_path)
    with pytest.raises(ValueError):
        golden.load_cases(tmp_path / "nowhere")
