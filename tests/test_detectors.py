"""Detectors on hand-made frames: each rule's positive and negative side."""

from __future__ import annotations

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom import cli, projection
from factloom.functions import exprs as X
from factloom.operators import detect, remember, report, versions
from factloom.rules import DECISIONS, DRIFT_TYPES, RuleContext
from factloom.sources import sinks
from factloom.streaming import incremental

DOC = "doc_id long, group_id long, prev_id long, filename string, source_type string, authority double, parsed_at date"
FACT = "fact_id string, subject_id long, predicate string, pred_fold string, object_type string, object_number double, canon_object string, measure_unit string, doc_id long, valid_from date, valid_to date, valid_to_anchor string, observed_at date"
CTX = RuleContext(as_of=date(2026, 6, 1), pricing_stale_days=90, severity={"pricing_change": "critical", "policy_change": "warning"})


@pytest.fixture
def make(spark):
    def docs(*rows):
        return spark.createDataFrame([(i, g, p, f"d{i}", t, a, date(2026, 1, 1)) for i, g, p, t, a in rows], DOC)

    def facts(*rows):
        out = []
        for r in rows:
            f = {"id": None, "subject": 1, "predicate": "Price", "number": 1.0, "unit": None, "doc": None, "start": None, "end": None, "anchor": None, "observed": None, **r}
            text = str(int(f["number"])) if f["number"] == int(f["number"]) else str(f["number"])
            out.append((f["id"], f["subject"], f["predicate"], f["predicate"].lower(), "number", float(f["number"]), f"scalar|number|{text}", f["unit"], f["doc"], f["start"], f["end"], f["anchor"], f["observed"]))
        return spark.createDataFrame(out, FACT)

    return docs, facts


def test_conflicts(make):
    docs, facts = make
    d = docs((1, None, None, "general", 0.9), (2, None, None, "general", 0.8), (3, None, None, "pricing", 0.99), (4, 7, None, "general", 0.9), (5, 7, 4, "general", 0.9))
    cases = [
        ([{"id": "a", "doc": 1, "number": 100}, {"id": "b", "doc": 2, "number": 150}], "high", 0.8),
        ([{"id": "a", "doc": 1, "number": 100}, {"id": "b", "doc": 3, "number": 150}], "critical", 0.9),
        ([{"id": "a", "doc": 1, "number": 100}, {"id": "b", "doc": 1, "number": 150}], None, None),
        ([{"id": "a", "doc": 1, "number": 149}, {"id": "b", "doc": 2, "number": 149.0}], None, None),
        ([{"id": "a", "doc": 1, "number": 1}, {"id": "b", "doc": 4, "number": 2}], None, None),
        ([{"id": "a", "doc": 1, "number": 1, "end": date(2026, 5, 31)}, {"id": "b", "doc": 2, "number": 2}], None, None),
        ([{"id": "a", "doc": 1, "number": 1, "end": date(2026, 6, 1)}, {"id": "b", "doc": 2, "number": 2}], "high", 0.8),
        ([{"id": "a", "doc": 1, "number": 1, "end": date(2026, 7, 1)}, {"id": "b", "doc": 2, "number": 2, "start": date(2026, 7, 2)}], None, None),
        ([{"id": "a", "doc": 1, "number": 1, "predicate": "PRICE"}, {"id": "b", "doc": 2, "number": 2}], "high", 0.8),
        ([{"id": "a", "doc": None, "number": 1}, {"id": "b", "doc": 99, "number": 2}], "high", 0.95),
    ]
    for rows, severity, confidence in cases:
        found = detect.conflicts(facts(*rows), d, CTX).collect()
        assert [(r.severity, r.confidence) for r in found] == ([(severity, confidence)] if severity else []), rows
    multi = RuleContext(as_of=CTX.as_of, multi_valued=frozenset({"price"}))
    assert detect.conflicts(facts(*cases[0][0]), d, multi).count() == 0
    later = detect.conflicts(facts({"id": "a", "doc": 1, "number": 1}, {"id": "b", "doc": 2, "number": 2, "observed": date(2025, 1, 1)}), d, CTX).first()
    assert (later.old_fact_id, later.new_fact_id) == ("b", "a")


def test_staleness_ladder(make):
    docs, facts = make
    d = docs((1, None, None, "general", 0.9), (4, 7, None, "general", 0.9), (5, 7, 4, "general", 0.9), (6, None, None, "pricing", 0.9), (8, None, None, "policy", 0.9))
    old = date(2026, 5, 1)
    rows = [
        ({"id": "quoted", "doc": 1, "end": old, "anchor": "quoted"}, ("confirmed_stale", "valid_to_expired", "medium")),
        ({"id": "legacy", "doc": 1, "end": old}, ("confirmed_stale", "valid_to_expired", "medium")),
        ({"id": "lowered", "doc": 8, "end": old}, ("confirmed_stale", "valid_to_expired", "warning")),
        ({"id": "both", "doc": 4, "end": old}, ("confirmed_stale", "valid_to_expired+superseding_source", "medium")),
        ({"id": "replaced", "doc": 4, "end": old, "anchor": "calendar_derived"}, ("confirmed_stale", "superseding_source", "medium")),
        ({"id": "inferred", "doc": 1, "end": old, "anchor": "document_scope"}, ("possibly_stale", "inferred_validity_expired", "warning")),
        ({"id": "boundary", "doc": 1, "end": CTX.as_of, "start": date(2026, 5, 2)}, None),
        ({"id": "aged", "doc": 1, "observed": date(2025, 5, 31)}, ("possibly_stale", "age_over_threshold", "warning")),
        ({"id": "not yet", "doc": 1, "observed": date(2025, 6, 1)}, None),
        ({"id": "pricing", "doc": 6, "observed": date(2026, 3, 2)}, ("possibly_stale", "age_over_threshold", "warning")),
        ({"id": "annual", "doc": 6, "start": date(2026, 1, 1)}, None),
        ({"id": "last year", "doc": 6, "start": date(2025, 1, 1)}, ("possibly_stale", "age_over_threshold", "warning")),
        ({"id": "current edition", "doc": 5, "observed": date(2020, 1, 1)}, None),
        ({"id": "undated", "doc": 1}, None),
    ]
    got = {r.fact_id: (r.drift_type, r.reason, r.severity) for r in detect.stale(facts(*[f for f, _ in rows]), d, CTX).collect()}
    assert got == {f["id"]: want for f, want in rows if want}


def test_versions_and_reuse(make):
    docs, facts = make
    d = docs((1, 7, None, "general", 0.9), (2, 7, 1, "general", 0.9), (3, 7, 2, "general", 0.9), (9, None, None, "pricing", 0.9), (20, 8, None, "general", 0.9), (21, 8, None, "general", 0.9), (30, None, 77, "general", 0.9))
    assert {(r.old_document_id, r.new_document_id) for r in detect.superseded(d, CTX).collect()} == {(1, 2), (2, 3)}
    assert {(r.group_id, r.head_id) for r in versions.heads(d).collect()} == {(7, 3)}
    assert {(r.head_id, r.doc_id, r.distance) for r in versions.distances(d).collect()} == {(3, 2, 1), (3, 1, 2)}
    chains = {r.doc_id: r.chain for r in versions.components(d).collect()}
    assert chains == {1: 1, 2: 1, 3: 1, 9: 9, 20: 20, 21: 20, 30: 30}
    f = facts(
        {"id": "old1", "doc": 1, "number": 70, "unit": "CNY"},
        {"id": "old2", "doc": 2, "number": 70, "unit": "cny "},
        {"id": "head", "doc": 3, "number": 80, "unit": "CNY"},
        {"id": "reuse", "doc": 9, "number": 70, "unit": "CNY"},
        {"id": "other unit", "doc": 9, "number": 70, "unit": "USD"},
        {"id": "other subject", "doc": 9, "number": 70, "unit": "CNY", "subject": 2},
        {"id": "ended", "doc": 9, "number": 70, "unit": "CNY", "end": date(2026, 1, 1)},
    )
    (hit,) = detect.reused_values(f, d, CTX).collect()
    assert (hit.fact_id, hit.old_document_id, hit.distance, hit.new_fact_id, hit.head_value, hit.severity) == ("reuse", 2, 1, "head", 80, "critical")


def test_long_chains_are_walked_to_their_end(make):
    docs, facts = make
    d = docs(*[(k, 7, k - 1 if k > 1 else None, "general", 0.9) for k in range(1, 151)], (900, None, None, "general", 0.9), (400, 8, 401, "general", 0.9), (401, None, 402, "general", 0.9), (402, None, 401, "general", 0.9))
    assert {(r.head_id, r.doc_id, r.distance) for r in versions.distances(d).collect()} == {(150, k, 150 - k) for k in range(1, 150)} | {(400, 401, 1), (400, 402, 2)}
    f = facts({"id": "first", "doc": 1, "number": 5, "unit": "CNY"}, {"id": "head", "doc": 150, "number": 6, "unit": "CNY"}, {"id": "reuse", "doc": 900, "number": 5, "unit": "CNY"})
    (hit,) = detect.reused_values(f, d, CTX).collect()
    assert (hit.fact_id, hit.old_document_id, hit.distance, hit.head_value) == ("reuse", 1, 149, 6)


def test_cycles_end(make):
    docs, _ = make
    d = docs((1, 7, 2, "general", 0.9), (2, 7, 1, "general", 0.9))
    assert versions.heads(d).count() == 0 and versions.distances(d).count() == 0
    assert {r.chain for r in versions.components(d).collect()} == {1}


def test_duplicates(spark):
    entities = spark.createDataFrame([(1, "Acme Plus Plan", [1.0, 0.0]), (2, "acme  plus plan", None), (3, "Acme Plus", None), (4, "Zeta", [1.0, 0.0]), (5, "Other", None)], "entity_id long, name string, embedding array<double>")
    fact = lambda s, p, v: (s, p, v)
    facts = spark.createDataFrame([fact(1, "p", "a"), fact(2, "p", "a"), fact(1, "q", "g"), fact(2, "q", "g"), fact(3, "q", "g"), fact(1, "r", "u"), fact(4, "r", "u"), fact(3, "q", "x"), fact(5, "s", "y")], "subject_id long, pred_fold string, canon_object string")
    got = {(r.a, r.b): (r.shared, r.recall) for r in detect.duplicates(entities, facts).collect()}
    assert got == {(1, 2): (2, "exact_normalized_name"), (1, 4): (1, "embedding_similarity")}


def test_duplicates_need_overlap_and_more_than_one_chain(make, spark):
    docs, _ = make
    d = docs((1, 7, None, "general", 0.9), (2, 7, 1, "general", 0.9), (3, None, None, "general", 0.9))
    ends, starts = date(2025, 12, 31), date(2026, 1, 1)
    rows = []

    def both(a, b, doc_a, doc_b, values, to_a=None, from_b=None):
        for v in values:
            rows.extend([(f"{a}-{v}-{len(rows)}", a, "p", v, doc_a, None, to_a), (f"{b}-{v}-{len(rows)}", b, "p", v, doc_b, from_b, None)])

    both(1, 2, 1, 2, ["a", "b"])  # editions of one handbook
    both(3, 4, 1, 3, ["c", "d"])  # two documents without a common chain
    both(5, 6, 1, 99, ["e", "f"])  # an unknown document
    both(7, 8, 1, 1, ["g", "h"])  # one document
    both(9, 10, 1, 3, ["i", "j"], ends, starts)  # disjoint validity
    both(11, 12, 1, 3, ["k"])
    both(11, 12, 1, 3, ["l"], ends, starts)  # only one of two overlaps, and nobody else holds it
    both(13, 14, 1, 3, ["m"])
    both(13, 14, 1, 3, ["n"], ends, starts)
    both(15, 16, 1, 3, ["m"])  # one fact of four holders
    both(17, 18, 1, 3, ["o"])
    both(17, 18, 3, 3, ["o"])
    both(19, 20, 1, 3, ["o"])  # one fact of four holders, but stated twice by 17 and 18
    names = [(k, f"Name{(k + 1) // 2}", None) for k in range(1, 21)]
    entities = spark.createDataFrame(names, "entity_id long, name string, embedding array<double>")
    facts = spark.createDataFrame(rows, "fact_id string, subject_id long, pred_fold string, canon_object string, doc_id long, valid_from date, valid_to date")
    got = {(r.a, r.b): r.shared for r in detect.duplicates(entities, facts, d).collect()}
    assert got == {(3, 4): 2, (5, 6): 2, (7, 8): 2, (11, 12): 1, (17, 18): 4}
    assert detect.duplicate_facts(entities, facts, d).groupBy("a", "b").count().where("a = 17").first()["count"] == 4


def test_scan_runs_all_detectors(spark):
    found = cli.all_findings(spark, "/root/testdata/sf0.001", projection.RULES)
    assert {r.drift_type for r in found.select("drift_type").distinct().collect()} == set(DRIFT_TYPES)
    assert found.where("drift_type = 'duplicate'").count() == detect.duplicates(*_projected(spark)).agg({"shared": "sum"}).first()[0]
    row = found.where("drift_type = 'conflict'").first()
    assert {"reason", "subject", "predicate", "old_source", "new_source", "old_value", "new_value"} == set(json.loads(row.detail)) and row.reason == "overlapping_validity_different_objects"


def _projected(spark):
    return projection.entities(spark, "/root/testdata/sf0.001"), projection.entity_facts(spark, "/root/testdata/sf0.001")


def test_second_scan_is_silent_and_reports_render(make, spark, tmp_path):
    docs, facts = make
    d = docs((1, 7, None, "pricing", 0.9), (2, 7, 1, "pricing", 0.9))
    found = detect.superseded(d, CTX)
    first = sinks.append_findings(found, str(tmp_path), "0001")
    assert first.count() == 1 and sinks.append_findings(found, str(tmp_path), "0002").count() == 0
    made = report.build(first)
    assert made["gate"] == {"fail_on": "critical", "blocking": 1, "failed": True} and made["by_type"]["superseded"] == 1
    assert '"superseded": 1' in report.render_json(made) and "<script" not in report.render_html({**made, "items": [{"title": "<script>", "severity": "x"}]})
    f = facts({"id": "a", "doc": 1}, {"id": "b", "doc": 2})
    named = spark.createDataFrame([(1, "Plan", "product"), (2, "Team", "team")], "entity_id long, name string, entity_type string")
    first_hash = sinks.append_snapshot(f, named, str(tmp_path), "0001")
    assert first_hash == sinks.append_snapshot(f.orderBy("fact_id", ascending=False), named, str(tmp_path), "0002")
    # what a fact says, its status and its subject's type count; ids do not
    for other in (f.withColumn("status", F.lit("retracted")), f.withColumn("object_number", F.lit(7.0)), f.withColumn("valid_to", F.lit("2026-01-01").cast("date"))):
        assert sinks.append_snapshot(other, named, str(tmp_path), "0003") != first_hash
    assert sinks.append_snapshot(f, named.withColumn("entity_type", F.lit("other")), str(tmp_path), "0003") != first_hash
    assert sinks.append_snapshot(f.withColumn("fact_id", F.concat(F.lit("x"), "fact_id")), named, str(tmp_path), "0003") == first_hash
    assert sinks.latest_snapshot(spark, str(tmp_path)).scan_id == "0003" and sinks.published(spark, str(tmp_path), "snapshot_facts") == ["0001", "0002", "0003"]


def test_hash_of_what_is_known(make, spark):
    import hashlib

    _, facts = make
    named = spark.createDataFrame([(1, 'Plan "A"', "product")], "entity_id long, name string, entity_type string")
    f = facts({"id": "a", "number": 5}, {"id": "b", "number": 5.5, "start": date(2026, 1, 1)}).withColumn("status", F.lit("active"))
    base = {"object_entity": None, "object_entity_type": None, "object_type": "number", "predicate": "Price", "status": "active", "subject": 'Plan "A"', "subject_type": "product", "valid_to": None}
    records = [{**base, "object_value": 5, "valid_from": None}, {**base, "object_value": 5.5, "valid_from": "2026-01-01"}]
    lines = sorted(json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in records)
    got = remember.knowledge_hash(remember.fact_records(f, named)).first()
    assert (got.knowledge_hash, got.facts) == (hashlib.sha256("".join(x + "\n" for x in lines).encode()).hexdigest(), 2)
    assert remember.knowledge_hash(remember.fact_records(f.limit(0), named)).first().knowledge_hash == hashlib.sha256(b"").hexdigest()


def test_a_scan_that_runs_again_keeps_its_rows(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "fingerprint string")
    kept = lambda: {r.scan_id: r.n for r in sinks.stored_rows(spark, str(tmp_path), "findings").groupBy("scan_id").agg(F.count("*").alias("n")).collect()}
    assert sinks.append_findings(rows("a", "b", "b"), str(tmp_path), "scan-2").count() == 2
    assert sinks.append_findings(rows("b", "c"), str(tmp_path), "scan-10").count() == 1
    assert kept() == {"scan-2": 2, "scan-10": 1}
    assert sinks.append_findings(rows("a", "b"), str(tmp_path), "scan-2").count() == 2
    assert sinks.append_findings(rows("b", "c"), str(tmp_path), "scan-10").count() == 1
    assert kept() == {"scan-2": 2, "scan-10": 1} and sinks.published(spark, str(tmp_path), "findings") == ["scan-2", "scan-10"]


def test_a_stream_that_runs_again_stores_nothing_twice(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    rows = [("a", "2026-01-01"), ("a", "2026-01-01"), ("b", "2026-01-02")]
    spark.createDataFrame(rows, "fingerprint string, effective_at string").withColumn("effective_at", F.col("effective_at").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = lambda: incremental.first_findings(spark.readStream.schema("fingerprint string, effective_at timestamp").parquet(source))
    for checkpoint in ("c1", "c2"):
        incremental.append_stream(stream(), root, str(tmp_path / checkpoint)).awaitTermination()
        assert sinks.stored_rows(spark, root, "findings").count() == 2


def test_activity_in_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("x", "2026-01-01 10:05:00", 1.0), ("x", "2026-01-01 10:55:00", 2.0), ("y", "2026-01-01 11:00:00", 4.0), ("x", "2026-01-02 00:00:00", 8.0)]
    spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = incremental.activity(spark.readStream.schema("event_type string, ts timestamp, value double").parquet(source))
    run = stream.writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("activity").collect()) == [("x", 1, 8.0), ("x", 2, 3.0), ("y", 1, 4.0)]


def test_decisions_count_once_and_only_if_valid(spark):
    found = spark.createDataFrame([(n, "old", "new") for n in "abcdefg"], "fingerprint string, old_fact_id string, new_fact_id string")
    log = spark.createDataFrame(
        [
            ("a", 2, "ignore", None, None, None), ("a", 1, "resolve", "accept_newer", None, "newer_version"), ("b", 1, "ignore", None, None, None), ("b", 2, "resolve", "keep_old", None, None), ("b", 3, "ignore", None, None, None),
            ("c", 1, "resolve", "keep_old", "new", None), ("d", 1, "resolve", "manual_override", "other", None), ("e", 1, "resolve", "maybe", None, None), ("e", 2, "resolve", "false_positive", None, "detector_noise"), ("f", 1, "close", None, None, None), ("zz", 1, "ignore", None, None, None),
        ],
        "fingerprint string, at long, action string, decision string, authority_fact string, reason_code string",
    )
    problems = {(r.fingerprint, r.at): r.problem for r in remember.judged_log(found, log).collect()}
    assert problems == {("a", 1): None, ("a", 2): "already_resolved", ("b", 1): None, ("b", 2): "already_ignored", ("b", 3): "repeated", ("c", 1): None, ("d", 1): "authority_not_of_finding", ("e", 1): "unknown_decision", ("e", 2): None, ("f", 1): "unknown_action", ("zz", 1): "unknown_finding"}
    status = {r.fingerprint: (r.status, r.authority_fact) for r in remember.latest_status(found, log).collect()}
    assert status == {"a": ("resolved", "new"), "b": ("ignored", None), "c": ("resolved", "new"), "d": ("open", None), "e": ("resolved", None), "f": ("open", None), "g": ("open", None)}


def test_findings_of_a_document_roll_up(spark):
    rows = [("f1", "confirmed_stale", "d1", "valid_to_expired", "medium"), ("f2", "confirmed_stale", "d1", "valid_to_expired", "critical"), ("f3", "possibly_stale", "d1", "age_over_threshold", "warning"), ("f4", "confirmed_stale", "d2", remember.SELF_DECLARED, "medium"), ("f5", "possibly_stale", "d2", "age_over_threshold", "warning"), ("f6", "confirmed_stale", "d3", remember.SELF_DECLARED, "high"), ("f7", "conflict", "d1", None, "high"), ("f8", "conflict", "d1", None, "high"), ("f9", "possibly_stale", None, "age_over_threshold", "warning")]
    found = spark.createDataFrame(rows, "fingerprint string, drift_type string, doc_id string, reason string, severity string").withColumn("effective_at", F.lit(None).cast("timestamp"))
    groups, alone = remember.roll_up(found)
    got = {(r.doc_id, r.drift_type, r.head): (r.issues, r.severity, r.fingerprints) for r in groups.collect()}
    assert got == {("d1", "confirmed_stale", None): (2, "critical", ["f1", "f2"]), ("d2", "confirmed_stale", "f4"): (2, "medium", ["f4", "f5"]), ("d3", "confirmed_stale", "f6"): (1, "high", ["f6"])}
    assert {r.fingerprint for r in alone.collect()} == {"f3", "f7", "f8", "f9"}


def test_every_finding_has_a_story():
    for kind, reason in report.STORIES:
        told = report.story(kind, {"reason": reason, "subject": "S"})
        assert told["title"] and "{" not in told["title"] + told["why"] and set(told["suggested_decisions"]) <= set(DECISIONS)
    assert {k for k, _ in report.STORIES} == set(DRIFT_TYPES)


def test_ways_to_the_newest_edition(spark):
    steps = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100)], "doc_id long, new_id long")
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 42), 100, 101]], "doc_id long")
    assert {r.doc_id: r.head_id for r in versions.ends(steps, nodes).collect()} == {**{k: 40 for k in range(1, 41)}, 41: 41}


def _shared_pairs(facts):
    """By brute force: pairs of subjects with two shared facts or more, or one of two holders."""
    held = {}
    for s, p, o in facts:
        held.setdefault((p, o), set()).add(s)
    own = {}
    for key, subjects in held.items():
        for s in subjects:
            own.setdefault(s, set()).add(key)
    names = sorted(own)
    out = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = own[a] & own[b]
            if len(both) > 1 or any(len(held[k]) == 2 for k in both):
                out.add((a, b, len(both)))
    return out


@pytest.mark.parametrize("wide", [2, 4, 1000])
def test_shared_fact_pairs_by_every_way_to_meet(spark, monkeypatch, wide):
    pick = random.Random(wide)
    facts = [(s, f"p{pick.randrange(4)}", str(int(pick.paretovariate(0.6)) % 30)) for s in range(120) for _ in range(pick.choice([1, 2, 3, 12]))]
    facts += [(500, p, o) for p in ("p0", "p1", "p2", "p3") for o in map(str, range(30))] + [(501, "p0", str(o)) for o in range(25)]
    monkeypatch.setattr(detect, "RARE", 5)
    monkeypatch.setattr(detect, "WIDE", wide)
    got = {tuple(r) for r in detect.shared_fact_pairs(spark.createDataFrame(facts, "subject_id long, pred_fold string, canon_object string")).collect()}
    want = _shared_pairs(facts)
    assert got == want and len(want) > 100


def test_a_subject_with_5000_shared_facts(spark):
    wide = spark.range(5_000).selectExpr("0 as subject_id", "'p' as pred_fold", "cast(id as string) as canon_object")
    others = spark.range(200_000).selectExpr("cast(1 + id % 4000 as int) as subject_id", "'p' as pred_fold", "cast(xxhash64(id) % 5000 as string) as canon_object")
    got = detect.shared_fact_pairs(wide.unionByName(others).select(F.col("subject_id").cast("long"), "pred_fold", "canon_object"))
    mine = others.where("canon_object >= '0'").select("subject_id", "canon_object").distinct().groupBy("subject_id").agg(F.count("*").alias("n")).where("n > 1")
    assert got.where("a = 0").count() == mine.count() > 3000


def test_no_pair_is_sent_anywhere(spark):
    facts = spark.createDataFrame([(s, p, v) for s in range(40) for p, v in (("p", str(s % 2)), ("q", str(s % 3)), ("r", str(s % 5)))], "subject_id long, pred_fold string, canon_object string")
    entities = spark.createDataFrame([(s, f"Name {s % 4}", [1.0, float(s)]) for s in range(40)], "entity_id long, name string, embedding array<double>")
    for got in (detect.shared_fact_pairs(facts), detect.shared_fact_pairs(facts, entities), detect.duplicates(entities, facts)):
        above = got._jdf.queryExecution().executedPlan().toString().split("Join")[0]
        assert "Exchange" not in above and "Aggregate" not in above
        assert got.count() == got.select("a", "b").distinct().count() > 0
    pairs = detect.shared_fact_pairs(facts)
    assert sorted(detect.recalled(pairs, entities).collect()) == sorted(detect.shared_fact_pairs(facts, entities).collect())


def test_equal_lines_are_hashed_as_often_as_they_come(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(remember, "PACK_BYTES", 500)
    monkeypatch.setattr(remember, "REPEATS", 3)
    records = spark.range(2_000).selectExpr("concat('{\"n\":', id % 150, '}') as record").repartition(7)
    lines = sorted(f'{{"n":{i % 150}}}\n' for i in range(2_000))
    got = remember.knowledge_hash(records)
    assert (got.first().knowledge_hash, got.first().facts) == (hashlib.sha256("".join(lines).encode()).hexdigest(), 2_000)
    # what the one task reads is counted and packed before
    assert "HashAggregate(keys=[record" in got._jdf.queryExecution().executedPlan().toString()


def test_ids_travel_as_bytes(spark):
    ids = ["00ff", "00fF", "abc", "0abc", "", "é", "zz", None, "a" * 64]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", X.packed(F.col("id")).alias("p")).select("id", "p", X.unpacked(F.col("p")).alias("back")).collect()
    assert [r.back for r in rows] == ids
    assert len({bytes(r.p) for r in rows if r.p is not None}) == len(ids) - 1
    assert len(rows[-1].p) == 33


def test_facts_meet_their_documents_once(make):
    docs, facts = make
    d = docs((1, None, None, "general", 0.9), (4, 7, None, "general", 0.9), (5, 7, 4, "general", 0.9))
    spark = d.sparkSession
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = detect.stale(facts({"id": "ab", "doc": 4}), d, CTX)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # after facts and documents have met, nothing is sent again
    top = plan.splitlines()
    sends = [len(line) - len(line.lstrip(" :+-|")) for line in top if "Exchange hashpartitioning" in line]
    joins = [len(line) - len(line.lstrip(" :+-|")) for line in top if "SortMergeJoin" in line]
    assert min(joins) < min(sends) and sum(j < min(sends) for j in joins) == 1


def test_equal_subjects_are_compared_once(spark, monkeypatch):
    """Copies meet others as one row, and every pair of their members is still found."""
    monkeypatch.setattr(detect, "PACK", 7)
    rng = random.Random(4)
    kinds = [([("f", str(rng.randrange(4))) for _ in range(1)] + [("g", str(rng.randrange(3))), ("h", str(rng.randrange(3)))], rng.choice(["red gear", "gear red", "red gear wide", "bolt", ""]), rng.choice([[1.0, 0.0], [0.0, 1.0], None])) for _ in range(12)]
    subjects = [(i, *kinds[i % len(kinds)]) for i in range(240)]
    facts = spark.createDataFrame([(i, p, o) for i, fs, _, _ in subjects for p, o in fs] + [(None, "f", "0"), (1, "f", None)], "subject_id long, pred_fold string, canon_object string")
    entities = spark.createDataFrame([(i, n, e) for i, _, n, e in subjects], "entity_id long, name string, embedding array<double>")
    held = {}
    for i, fs, _, _ in subjects:
        for f in fs:
            held.setdefault(f, set()).add(i)
    own = {i: set(fs) for i, fs, _, _ in subjects}
    want = {}
    for a in own:
        for b in own:
            both = own[a] & own[b]
            if a < b and (len(both) > 1 or any(len(held[f]) == 2 for f in both)):
                want[a, b] = len(both)
    met, within = [], detect.tiles.within

    def counted(rows, *args):
        met.append(rows.count())
        return within(rows, *args)

    monkeypatch.setattr(detect.tiles, "within", counted)
    pairs = detect.shared_fact_pairs(facts)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and {(a, b): n for a, b, n in got} == want
    # three combinations of two facts for a pack of 20 copies at most: 3 a kind, and some more as they are dealt by a hash
    assert met[0] <= 12 * 3 * 6 < 240 * 3
    named = detect.shared_fact_pairs(facts, entities, 0.5)
    assert sorted(named.collect()) == sorted(detect.recalled(pairs, entities, 0.5).collect())
    equal = detect.shared_fact_pairs(facts, entities, 0.5, exact=True)
    assert sorted(equal.collect()) == sorted(named.where("recall = 'exact_normalized_name'").collect())


def test_vectors_of_a_tile_are_compared_at_once(spark, monkeypatch):
    """Parts of three vectors meet in tiles; of what meets there only near pairs go on, and odd vectors are judged as ever."""
    monkeypatch.setattr(detect, "VECTORS", 3)
    rng = random.Random(5)
    odd = [None, [], [0.0, 0.0], [1.0], [float("nan"), 1.0], [None, 1.0]]
    subjects = [(i, [("f", str(i % 2)), ("g", str(i % 3)), ("h", str(i % 5))], rng.choice(["a b", "c d", f"n{i}"]), odd[i] if i < len(odd) else [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(70)]
    facts = spark.createDataFrame([(i, p, o) for i, fs, _, _ in subjects for p, o in fs], "subject_id long, pred_fold string, canon_object string")
    entities = spark.createDataFrame([(i, n, e) for i, _, n, e in subjects], "entity_id long, name string, embedding array<double>")
    pairs = detect.shared_fact_pairs(facts)
    seen, paired = [], detect._paired

    def counted(x, *args):
        seen.append((x.count(), x.columns))
        return paired(x, *args)

    monkeypatch.setattr(detect, "_paired", counted)
    got = detect.shared_fact_pairs(facts, entities, 0.9)
    want = detect.recalled(pairs, entities, 0.9)
    assert sorted(got.collect()) == sorted(want.collect()) and want.where("recall = 'embedding_similarity'").count() > 20
    # those that only cannot be told are few
    assert seen[-1][1] == ["a", "b"] and seen[-1][0] < pairs.count() / 2
