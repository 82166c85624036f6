"""The command line from files to decisions, and the state that it leaves."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom import cli, config, projection
from factloom.operators import attributes, detect, remember, report
from factloom.plans import catalog
from factloom.sources import files, ingest, sinks
from tests.test_golden import YAML

SMALL = "/root/testdata/sf0.001"


def fingerprints(spark, state):
    return {r.fingerprint for r in sinks.stored_rows(spark, state, "findings").collect()}


def test_scan_decide_and_scan_again(spark, tmp_path, capsys):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    assert cli.main(["drift", "list", "--state", state]) == 2
    assert cli.main(["scan", SMALL, "--state", state, "--scan-id", "one", "--out", out]) == 1
    first = fingerprints(spark, state)
    made = json.loads((tmp_path / "out/report.json").read_text())
    assert sum(made["by_type"].values()) == len(first) == made["by_status"]["open"] and made["groups_total"] > 0 and made["totals"]["findings"] == len(first)
    assert "Knowledge drift" in (tmp_path / "out/report.html").read_text()
    assert all(n > 0 for t, n in made["by_type"].items())
    # every finding is in some page, and the artifacts hold the whole run
    said = json.loads((tmp_path / "out/manifest.json").read_text())
    pages = spark.read.json(f"{out}/pages/findings")
    assert {r.fingerprint for r in pages.select("fingerprint").collect()} == first and pages.count() == len(first) == said["pages"]["rows"]["findings"]
    assert pages.groupBy("page").count().agg({"count": "max"}).first()[0] <= report.PAGE and pages.where(F.col("page") != F.floor(F.col("place") / report.PAGE)).isEmpty()
    assert [r.fingerprint for r in pages.orderBy("place").collect()] == [r.fingerprint for r in remember.ordered(pages.select("fingerprint", "severity", F.col("effective_at").cast("timestamp"))).collect()]
    groups = spark.read.json(f"{out}/pages/groups")
    assert groups.count() == made["groups_total"] and groups.where("filename is null").isEmpty()
    assert sinks.read_jsonl(spark, f"{out}/drifts").select("fingerprint").distinct().count() == len(first) and sinks.read_jsonl(spark, f"{out}/facts").count() == 6000
    assert said["knowledge_hash"] == sinks.latest_snapshot(spark, state).knowledge_hash == catalog.QUERIES["knowledge_hash"](spark, SMALL).first().knowledge_hash
    things = sinks.stored_rows(spark, state, "snapshot_entities")
    assert things.count() == things.select("entity_id").distinct().count() == said["entities"]
    # a scan that is run again stores the same rows; another one stores none
    assert cli.main(["scan", SMALL, "--state", state, "--scan-id", "one"]) == 1
    assert fingerprints(spark, state) == first and sinks.published(spark, state, "findings") == ["one"]
    assert cli.main(["scan", SMALL, "--state", state, "--scan-id", "two", "--fail-on", "none"]) == 0
    assert fingerprints(spark, state) == first and sinks.published(spark, state, "findings") == ["one", "two"]
    assert {r.scan_id: (r.status, r.findings) for r in sinks.audit(spark, state).collect()} == {"one": ("completed", len(first)), "two": ("completed", 0)}
    head = sinks.latest_snapshot(spark, state)
    assert (head.scan_id, head.parent) == ("two", "one") and head.rows == 6000
    capsys.readouterr()

    a, b = sorted(first)[:2]
    assert cli.main(["drift", "show", a, "--state", state]) == 0 and a in capsys.readouterr().out
    assert cli.main(["drift", "ignore", a, "--state", state, "--reason", "known"]) == 0
    assert cli.main(["drift", "ignore", a, "--state", state]) == 0
    assert cli.main(["resolve", a, "--state", state, "--decision", "keep_old"]) == 2
    for bad in (["--decision", "guess"], ["--decision", "keep_old", "--reason-code", "guess"], ["--decision", "keep_old", "--authority-fact", "none of it"]):
        assert cli.main(["resolve", b, "--state", state, *bad]) == 2
    assert cli.main(["resolve", b[:20], "--state", state, "--decision", "manual_override", "--reason-code", "manual", "--by", "me"]) == 0
    assert cli.main(["resolve", b, "--state", state, "--decision", "manual_override"]) == 2
    assert cli.main(["drift", "show", "no such", "--state", state]) == 2
    capsys.readouterr()
    for status, n in (("ignored", 1), ("resolved", 1), ("open", 5)):
        assert cli.main(["drift", "list", "--state", state, "--status", status, "--limit", "5"]) == 0
        assert f"{n} findings" in capsys.readouterr().out
    assert cli.main(["drift", "list", "--state", state, "--type", "odd"]) == 2


def test_a_failed_scan_is_told_in_the_audit(spark, tmp_path):
    assert cli.main(["scan", str(tmp_path / "nowhere"), "--state", str(tmp_path / "s"), "--scan-id", "x"]) == 2
    (row,) = sinks.audit(spark, str(tmp_path / "s")).collect()
    assert row.status == "failed" and row.error and sinks.published(spark, str(tmp_path / "s"), "findings") == []


SETTINGS = """
workspace: {name: demo}
sources:
  - {path: prices, type: pricing, authority: 0.8}
  - {path: gone, type: policy}
  - {path: ., type: general}
rules: {stale_after_days: 30}
severity: {pricing_change: critical}
ci: {fail_on: high}
ignore: ["**/draft*", "factloom.yaml"]
version_mapping:
  - group: list
    files:
      - {path: prices/old.csv, label: "1"}
      - {path: new.csv, label: "2", supersedes: old.csv}
      - {path: nowhere.csv}
"""


def test_check_ingests_once_and_tells_what_fails(spark, tmp_path, capsys, monkeypatch):
    work, state = tmp_path / "work", str(tmp_path / "state")
    (work / "prices").mkdir(parents=True)
    (work / "factloom.yaml").write_text(SETTINGS)
    (work / "prices/old.csv").write_text("name,price\nPlan,5\n")
    (work / "prices/new.csv").write_text("name,price\nPlan,6\n")
    (work / "note.md").write_text("one\n\ntwo")
    (work / "draft.txt").write_text("not yet")
    (work / "image.png").write_text("x")

    # a check that is stopped before it publishes leaves no file marked as parsed
    def stopped(*args):
        raise OSError("no space left")

    with monkeypatch.context() as broken:
        broken.setattr(sinks, "_publish", stopped)
        with pytest.raises(OSError):
            ingested = ingest.run(spark, str(work), config.load(work / "factloom.yaml"), None)
            sinks.publish_ingest(spark, state, ingested.documents, ingested.chunks, ingested.files)
    assert sinks.ingested(spark, state) is None
    assert cli.main(["check", str(work), "--state", state]) == 0
    told = capsys.readouterr().out
    assert "3 files, 3 new, 0 failed, 0 unchanged" in told
    assert "gone: missing_source" in told and "image.png: unsupported_type" in told and "nowhere.csv: missing" in told
    docs = {r.filename: r for r in sinks.ingested(spark, state)[0].collect()}
    assert docs["new.csv"].prev_id == docs["old.csv"].doc_id and docs["new.csv"].group_id == docs["old.csv"].group_id and docs["note.md"].group_id is None
    assert (docs["old.csv"].source_type, docs["old.csv"].authority, docs["note.md"].authority) == ("pricing", 0.8, 0.9)
    assert {r.text for r in sinks.ingested(spark, state)[1].collect()} == {"name: Plan; price: 5", "name: Plan; price: 6", "one\n\ntwo"}
    (work / "broken.xlsx").write_text("no workbook")
    assert cli.main(["check", str(work), "--state", state]) == 2
    done = capsys.readouterr()
    assert "4 files, 0 new, 1 failed, 3 unchanged" in done.out and "broken.xlsx" in done.err
    # a failed file is tried again; the others are not
    assert cli.main(["check", str(work), "--state", state]) == 2
    assert "4 files, 0 new, 1 failed, 3 unchanged" in capsys.readouterr().out
    assert sinks.ingested(spark, state)[1].count() == 3
    # nothing is read of files that have not changed, a copy under another name among them
    (work / "broken.xlsx").unlink()
    (work / "copy [1].md").write_text("one\n\ntwo")
    assert cli.main(["check", str(work), "--state", state]) == 0
    assert "4 files, 0 new, 0 failed, 4 unchanged" in capsys.readouterr().out
    read = []
    whole = files.with_content
    monkeypatch.setattr(files, "with_content", lambda spark, listing: read.append(listing.count()) or whole(spark, listing))
    assert cli.main(["check", str(work), "--state", state]) == 0 and read == [0]
    (work / "note.md").write_text("one\n\ntwo\n\nthree")
    assert cli.main(["check", str(work), "--state", state]) == 0 and read == [0, 1]
    assert sinks.ingested(spark, state)[1].count() == 4
    assert cli.main(["check", str(work), "--output", str(tmp_path / "r.json")]) == 2
    assert cli.main(["check", str(tmp_path / "nothing")]) == 2


def test_golden_cases_by_command(spark, tmp_path, capsys):
    cases = tmp_path / "cases"
    cases.mkdir()
    assert cli.main(["eval", "--cases", str(cases)]) == 2
    (cases / "one.yaml").write_text(YAML)
    # no benign case: the gate cannot pass
    assert cli.main(["eval", "--cases", str(cases), "--output", str(tmp_path / "e.json"), "--markdown", str(tmp_path / "e.md")]) == 1
    assert json.loads((tmp_path / "e.json").read_text())["total"]["tp"] == 1 and "# Golden run" in (tmp_path / "e.md").read_text()
    (cases / "two.yaml").write_text("cases: [{id: quiet, title: nothing here, category: negative}]")
    assert cli.main(["eval", "--cases", str(cases)]) == 0
    assert "2 of 2 cases pass" in capsys.readouterr().out


def test_query_by_command(spark, capsys):
    assert cli.main(["query", "superseded_docs", SMALL]) == 0 and "superseded" in capsys.readouterr().out
    assert cli.main(["query", "no_such", SMALL]) == 2


@pytest.mark.parametrize(
    "text",
    ["", "- a", "workspace: {name: ''}", "workspace: {name: x}\nmore: 1", "workspace: {name: x}\nsources: [{path: a}]", "workspace: {name: x}\nsources: [{path: a, type: b, authority: 3}]", "workspace: {name: x}\nrules: {stale_after_days: 0}", "workspace: {name: x}\nci: {fail_on: odd}", "workspace: {name: x}\nseverity: {a: odd}", "workspace: {name: x}\nversion_mapping: [{group: g, files: []}]", "workspace: {name: x}\nextraction: {provider: p}", "a: ["],
)
def test_bad_settings_are_refused(tmp_path, text):
    (tmp_path / "c.yaml").write_text(text)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "c.yaml")


def test_settings_have_defaults(tmp_path):
    from datetime import date

    (tmp_path / "c.yaml").write_text("workspace: {name: x}\nsources: [{path: a, type: b}]\n")
    s = config.load(tmp_path / "c.yaml")
    ctx = s.rules(date(2026, 1, 1))
    assert s.sources[0]["authority"] == 0.9 and s.fail_on == "critical" and (ctx.stale_after_days, ctx.pricing_days) == (365, 365) and "版本" in ctx.immutable and len(ctx.immutable) == 17
    assert s.digest() == config.load(tmp_path / "c.yaml").digest() and len(s.digest()) == 64


def test_a_scan_with_proposed_attributes(spark, tmp_path):
    """Pairs that the attributes clear are no conflicts any more, and what people should review is in the report."""
    clusters, texts = projection.clusters(spark, SMALL)
    clusters.write.parquet(str(tmp_path / "p/clusters.parquet"))
    texts.write.parquet(str(tmp_path / "p/texts.parquet"))
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    assert cli.main(["scan", SMALL, "--state", state, "--scan-id", "one", "--out", out, "--proposals", str(tmp_path / "p")]) == 1
    f, d = projection.facts(spark, SMALL), projection.documents(spark, SMALL)
    r = attributes.resolve(f, d, clusters, texts)
    found = sinks.stored_rows(spark, state, "findings").where("drift_type = 'conflict'")
    assert found.count() == attributes.conflicts(f, d, projection.RULES, r).count() < detect.conflicts(f, d, projection.RULES).count()
    review = spark.read.json(f"{out}/pages/review")
    assert {x.kind: x.n for x in attributes.channel_counts(attributes.channels(f, d, projection.RULES, r)).collect()} == {x["kind"]: x["count"] for x in review.groupBy("kind").count().collect()}
    made = json.loads((tmp_path / "out/report.json").read_text())
    assert sum(map(len, made["review"].values())) > 0


def test_evidence_and_decisions_of_a_finding(spark, tmp_path):
    found = spark.createDataFrame([("conflict", "high", "open", None, "fp1", "a", "b"), ("superseded", "medium", "open", None, "fp2", None, None)], "drift_type string, severity string, status string, effective_at timestamp, fingerprint string, old_fact_id string, new_fact_id string")
    evidence = spark.createDataFrame([("b", "new words", "n.md"), ("a", "old words", "o.md"), ("a", "old words", "o.md"), ("c", "none", "c.md")], "fact_id string, quote string, filename string")
    log = spark.createDataFrame([("fp1", 2, "resolve", "keep_old"), ("fp1", 1, "ignore", None)], "fingerprint string, at long, action string, decision string")
    held = report.write_whole(found, str(tmp_path / "w"), evidence, log, page=1)
    assert held == {"page": 1, "rows": {"findings": 2, "groups": 0}}
    one, two = spark.read.json(str(tmp_path / "w/findings")).orderBy("page").collect()
    assert (one.fingerprint, one.page, two.page) == ("fp1", 0, 1) and two.evidence is None and two.decisions is None
    assert [(e.side, e.quote) for e in one.evidence] == [(0, "old words"), (1, "new words")]
    assert [x.action for x in one.decisions] == ["ignore", "resolve"]
