"""Golden scenarios: small worlds with expected findings, all run through the detectors in one batch.

Cases come from YAML files with a list ``cases``, or are given as such dictionaries. Ids
inside a case are its own; they become numbers that no other case has. All cases share one
run of the detectors, whatever their rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import RULES, ConfigError, context, list_of, mapping, one_of, read_yaml, severities, share
from factloom.functions import exprs as X
from factloom.operators import evaluate
from factloom.operators.findings import detect_all, with_context
from factloom.rules import DRIFT_TYPES, INFERRED_ANCHORS, SEVERITY_RANK, TRUSTED_ANCHORS, RowRules, RuleContext
from factloom.session import stored

CATEGORIES = ("positive", "negative", "ambiguous_negative")
#: The day that cases without one are judged on; a fixed value.
AS_OF = date(2026, 6, 1)
DOCS = "doc_id long, group_id long, prev_id long, filename string, source_type string, authority double, parsed_at date"
RAW = "fact_id string, subject_id long, predicate string, object_type string, object_string string, object_number double, object_date date, object_bool boolean, object_entity_id string, measure_unit string, doc_id long, valid_from date, valid_to date, valid_to_anchor string, observed_at date"
ENTITIES = "entity_id long, name string, embedding array<double>"
FOUND = "case_id string, finding_id string, drift_type string, subject_id string, predicate string, severity string, old_source string, new_source string, target string"

_VALUE = (str, int, float, bool, date)


def _document(v, where):
    return mapping(v, {"id": str, "filename": str, "source_type": str, "authority": share, "parsed_at": date, "previous_version_of": str, "group": str}, where, ("id", "filename"))


def _entity(v, where):
    return mapping(v, {"id": str, "name": str, "type": str, "embedding": list_of(lambda x, _: float(x))}, where, ("id", "name"))


def _fact(v, where):
    f = mapping(
        v,
        {
            "id": str, "subject": str, "predicate": str, "value": _VALUE, "value_type": one_of(("number", "string", "boolean", "date", "entity")), "object_entity": str, "source": str,
            "valid_from": date, "valid_to": date, "observed_at": date, "measure_unit": str, "valid_to_anchor": one_of((*TRUSTED_ANCHORS, *INFERRED_ANCHORS)),
        },
        where,
        ("id", "subject", "predicate"),
    )
    kind = f["value_type"] or "string"
    if (kind == "entity") != (f["object_entity"] is not None) or (kind == "entity") == (f["value"] is not None):
        raise ConfigError(f"{where}: a fact of type {kind} needs {'an object_entity' if kind == 'entity' else 'a value'} and nothing else")
    return {**f, "value_type": kind}


def _expected(v, where):
    return mapping(v, {"type": one_of(DRIFT_TYPES), "subject": str, "predicate": str, "severity": one_of(SEVERITY_RANK), "old_source": str, "new_source": str, "target": one_of(("fact", "document"))}, where, ("type",))


def check_case(raw: dict) -> dict:
    """A case with defaults filled in; unknown keys, dangling references and expectations that the category forbids are refused."""
    name = f"case {raw.get('id') if isinstance(raw, dict) else raw!r}"
    case = mapping(
        raw,
        {
            "id": str, "title": str, "category": one_of(CATEGORIES), "as_of": date, "notes": str,
            "rules": lambda v, w: mapping(v, {**RULES, "severity": severities}, w),
            "documents": list_of(_document), "entities": list_of(_entity), "facts": list_of(_fact), "expected_drifts": list_of(_expected),
        },
        name,
        ("id", "title", "category"),
    )
    case = {**case, **{k: case[k] or [] for k in ("documents", "entities", "facts", "expected_drifts")}, "as_of": case["as_of"] or AS_OF}
    docs, things = {d["id"] for d in case["documents"]}, {e["id"] for e in case["entities"]}

    def known(what: str | None, among: set, told: str) -> None:
        if what is not None and what not in among:
            raise ConfigError(f"{name}: {told} refers to {what!r}, which is not there")

    for d in case["documents"]:
        known(d["previous_version_of"], docs - {d["id"]}, f"document {d['id']}")
    for f in case["facts"]:
        known(f["subject"], things, f"fact {f['id']}")
        known(f["object_entity"], things, f"fact {f['id']}")
        known(f["source"], docs, f"fact {f['id']}")
    for e in case["expected_drifts"]:
        known(e["subject"], things, "an expectation")
    if (case["category"] == "positive") != bool(case["expected_drifts"]):
        raise ConfigError(f"{name}: a positive case expects findings, others none")
    return case


def check_cases(cases: list[dict]) -> list[dict]:
    out = [check_case(c) for c in cases]
    seen: set[str] = set()
    for case in out:
        if case["id"] in seen:
            raise ConfigError(f"case {case['id']} is there twice")
        seen.add(case["id"])
    return out


def load_cases(folder: str | Path) -> list[dict]:
    """The cases of all YAML files of a folder, in the order of file names."""
    folder = Path(folder)
    if not folder.is_dir():
        raise ConfigError(f"{folder} is no folder")
    files = sorted(p for p in folder.iterdir() if p.is_file() and p.suffix in (".yaml", ".yml"))
    if not files:
        raise ConfigError(f"{folder} holds no YAML file")
    cases = []
    for path in files:
        suite = mapping(read_yaml(path), {"cases": list_of(lambda c, _: check_case(c), 1)}, str(path), ("cases",))
        cases += suite["cases"]
    return check_cases(cases)


def _context(case: dict) -> RuleContext:
    rules = case["rules"] or {}
    return context(rules, rules.get("severity"), case["as_of"])


def _row(f: dict, fact_id: str, subject: int, doc: int | None, entity: str | None) -> tuple:
    kind, value = f["value_type"], f["value"]
    if kind == "date" and isinstance(value, str):
        value = date.fromisoformat(value.strip())
    pick = lambda k, to: to(value) if kind == k else None
    typed = (None if entity else kind, pick("string", str), pick("number", float), pick("date", lambda v: v), pick("boolean", bool), entity)
    return (fact_id, subject, f["predicate"], *typed, f["measure_unit"], doc, f["valid_from"], f["valid_to"], f["valid_to_anchor"], f["observed_at"])


def findings(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """``FOUND``: the findings of all cases, with the ids that their case uses and the names of files.

    The rules of a case are a row of a relation that its facts and documents are joined
    with, so one run of the detectors serves all rule sets.
    """
    number, names, docs, raw, things, rules = 0, [], [], [], [], []
    for k, case in enumerate(check_cases(cases)):
        rules.append((k, RowRules.row(_context(case))))
        ids: dict[tuple[str, str | None], int | None] = {("d", None): None, ("g", None): None}
        for kind, local in [*(("d", d["id"]) for d in case["documents"]), *(("e", e["id"]) for e in case["entities"]), *(("g", d["group"]) for d in case["documents"])]:
            if (kind, local) not in ids:
                number += 1
                ids[kind, local] = number
                names.append((case["id"], str(number), local))
        for d in case["documents"]:
            docs.append((k, ids["d", d["id"]], ids["g", d["group"]], ids["d", d["previous_version_of"]], d["filename"], d["source_type"] or "general", 0.9 if d["authority"] is None else d["authority"], d["parsed_at"]))
        for e in case["entities"]:
            things.append((ids["e", e["id"]], e["name"], e["embedding"]))
        for f in case["facts"]:
            entity = str(ids["e", f["object_entity"]]) if f["object_entity"] else None
            raw.append((k, *_row(f, f"{case['id']}|{f['id']}", ids["e", f["subject"]], ids["d", f["source"]], entity)))
    if not rules:
        return spark.createDataFrame([], FOUND)
    out = _detect(spark, docs, raw, things, rules)
    named = spark.createDataFrame(names, "case_id string, n string, local string")
    x = out.withColumn("n", F.coalesce("subject_id", "old_document_id")).join(named.select("case_id", "n"), "n").drop("n")
    x = x.join(named.select(F.col("n").alias("subject_id"), F.col("local").alias("subject")), "subject_id", "left")
    return x.select("case_id", F.col("fingerprint").alias("finding_id"), "drift_type", F.col("subject").alias("subject_id"), "predicate", "severity", "old_source", "new_source", "target")


def _detect(spark: SparkSession, docs: list, raw: list, things: list, rules: list) -> DataFrame:
    own = spark.createDataFrame(rules, f"case_no int, rules {RowRules.SCHEMA}")
    # read by every detector
    d = stored(spark.createDataFrame(docs, f"case_no int, {DOCS}").join(own, "case_no").drop("case_no"), "golden-documents")
    typed = [F.col(c) for c in ("object_type", "object_string", "object_number", "object_date", "object_bool", "object_entity_id")]
    f = spark.createDataFrame(raw, f"case_no int, {RAW}").withColumns({"pred_fold": X.fold(F.col("predicate")), "canon_object": X.canonical_object(*typed)})
    f = stored(f.join(own, "case_no").drop("case_no"), "golden-facts")
    e = spark.createDataFrame(things, ENTITIES)
    # the same fact in two cases is not shared
    scope = F.concat(F.substring_index("fact_id", "|", 1), F.lit("|"))
    found = detect_all(f, d, e, RowRules(), f.withColumn("pred_fold", F.concat(scope, "pred_fold")))
    found = found.withColumn("predicate", F.when(F.col("drift_type") == "duplicate", F.substring_index("predicate", "|", -1)).otherwise(F.col("predicate")))
    x = with_context(found, d, e)
    return x.select("drift_type", "severity", "fingerprint", "subject_id", "predicate", "old_document_id", F.coalesce("old_source", "source").alias("old_source"), "new_source", F.col("target_type").alias("target"))


def expectations(spark: SparkSession, cases: list[dict]) -> DataFrame:
    rows = []
    for case in check_cases(cases):
        for k, e in enumerate(case["expected_drifts"]):
            rows.append((case["id"], f"{k:04d}", e["type"], e["subject"], e["predicate"], e["severity"], e["old_source"], e["new_source"], e["target"]))
    return spark.createDataFrame(rows, "case_id string, expected_id string, drift_type string, " + ", ".join(f"{n} string" for n in evaluate.LOCATORS))


@dataclass
class Suite:
    """What a run of cases gives: a row for each case, the totals with the gate, and both by type and category."""

    cases: DataFrame
    total: DataFrame
    by_type: DataFrame
    by_category: DataFrame
    missed: DataFrame
    unexpected: DataFrame


def run_suite(spark: SparkSession, cases: list[dict]) -> Suite:
    """All cases through the detectors, matched with what they expect."""
    found = stored(findings(spark, cases), "golden-findings")
    wanted = stored(expectations(spark, cases), "golden-expectations")
    matches = stored(evaluate.match_findings(wanted, found), "matches")
    names = spark.createDataFrame([(c["id"], c["category"]) for c in check_cases(cases)], "case_id string, category string")
    missed = wanted.join(matches.where("finding_id is null").select("case_id", "expected_id"), ["case_id", "expected_id"], "left_semi")
    unexpected = found.join(matches.where("finding_id is not null").select("case_id", "finding_id"), ["case_id", "finding_id"], "left_anti")
    return Suite(*evaluate.suite_metrics(names, wanted, missed, found, unexpected), missed, unexpected)
