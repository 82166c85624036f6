"""Command line. Exit codes: 0 passed, 1 gate failed, 2 error; an error outranks the gate.

    factloom check WORKSPACE [--state DIR] [--output FILE] [--html FILE]
    factloom scan TABLES --state DIR --scan-id ID [--config FILE] [--as-of DAY] [--fail-on SEVERITY] [--out DIR]
    factloom eval --cases DIR [--output FILE] [--markdown FILE]
    factloom drift list|show|ignore --state DIR ...
    factloom resolve FINGERPRINT --state DIR --decision DECISION ...
    factloom query NAME TABLES
"""

from __future__ import annotations

import argparse
import getpass
import json
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import config, projection
from factloom.operators import attributes, findings, golden, remember, report
from factloom.rules import DECISIONS, DRIFT_STATUS, DRIFT_TYPES, FAIL_ON_RANK, REASON_CODES, RuleContext
from factloom.session import build_session, stored
from factloom.sources import ingest, sinks

CONFIG = "factloom.yaml"


class UserError(ValueError):
    """Something that the caller asked for cannot be done."""


def frames(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Facts, documents and entities of a folder of knowledge tables, and facts of entities if they are apart; a folder of the star schema is projected."""
    if Path(folder, "facts.parquet").exists():
        return (*(spark.read.parquet(f"{folder}/{n}.parquet") for n in ("facts", "documents", "entities")), None)
    known = projection.entity_facts(spark, folder)
    known = known.withColumn("fact_id", F.sha2(F.to_json(F.array(F.col("subject_id").cast("string"), "pred_fold", "canon_object")), 256))
    return projection.facts(spark, folder), projection.documents(spark, folder), projection.entities(spark, folder), known


def all_findings(spark: SparkSession, folder: str, ctx: RuleContext, resolution: attributes.Resolution | None = None) -> DataFrame:
    """Findings of all detectors with their names, files and detail."""
    f, d, e, known = frames(spark, folder)
    return findings.with_detail(findings.with_context(findings.detect_all(f, d, e, ctx, known, resolution=resolution), d, e))


def proposals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Proposed clusters of predicates and equivalent texts, ``clusters.parquet`` and ``texts.parquet`` of a folder."""
    return spark.read.parquet(f"{folder}/clusters.parquet"), spark.read.parquet(f"{folder}/texts.parquet")


def state(spark: SparkSession, root: str) -> DataFrame:
    """All findings of a state folder with their status."""
    known = sinks.stored_rows(spark, root, "findings")
    if known is None:
        raise UserError(f"{root} holds no findings yet")
    return remember.latest_status(known, sinks.decisions(spark, root))


def one(spark: SparkSession, root: str, prefix: str) -> tuple[DataFrame, str]:
    """All findings, and the fingerprint that begins so."""
    found = state(spark, root)
    hits = [r.fingerprint for r in found.where(F.col("fingerprint").startswith(prefix)).select("fingerprint").distinct().limit(2).collect()]
    if len(hits) != 1:
        raise UserError(f"{'no' if not hits else 'more than one'} finding begins with {prefix}")
    return found, hits[0]


def _write(path: str | None, text: str) -> None:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")


def _open_report(spark: SparkSession, root: str, fail_on: str) -> dict:
    found = state(spark, root).withColumn("doc_id", F.coalesce("old_document_id", "new_document_id"))
    head = sinks.latest_snapshot(spark, root)
    return report.build(found, fail_on, totals={"knowledge_hash": head.knowledge_hash, "facts": head.rows, "entities": head.entities} if head else {})


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    path = Path(args.workspace)
    settings = config.load(path / CONFIG if path.is_dir() else path)
    base = str(path if path.is_dir() else path.parent)
    before = sinks.ingested(spark, args.state) if args.state else None
    done = ingest.run(spark, base, settings, *((before[0], before[2]) if before else ()))
    if args.state:
        sinks.publish_ingest(spark, args.state, done.documents, done.chunks, done.files)
    print(f"{settings.workspace}: " + ", ".join(f"{n} {k}" for k, n in done.counts.items()))
    for r in done.warnings.collect():
        print(f"warning: {r.path}: {r.warning}")
    for r in done.documents.where("status = 'failed'").collect():
        print(f"failed: {r.path}: {r.error}", file=sys.stderr)
    if args.output or args.html:
        if not args.state:
            raise UserError("a report needs --state")
        made = _open_report(spark, args.state, settings.fail_on)
        _write(args.output, report.render_json(made))
        _write(args.html, report.render_html(made))
    return 2 if done.counts["failed"] else 0


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    settings = config.load(args.config) if args.config else None
    day = date.fromisoformat(args.as_of) if args.as_of else None
    if settings is not None:
        ctx = settings.rules(day or date.today())
    else:
        ctx = RuleContext(**{**projection.RULES.__dict__, **({"as_of": day} if day else {})})
    fail_on = args.fail_on or (settings.fail_on if settings else "critical")
    with sinks.audited(spark, args.state, args.scan_id) as counts:
        facts, docs, entities, _ = frames(spark, args.tables)
        resolution = attributes.resolve(facts, docs, *proposals(spark, args.proposals)) if args.proposals else None
        channels = stored(attributes.channels(facts, docs, ctx, resolution), "channels") if resolution else None
        found = stored(all_findings(spark, args.tables, ctx, resolution).withColumn("scan_id", F.lit(args.scan_id)), "scan-findings")
        fresh = sinks.append_findings(found.drop("scan_id"), args.state, args.scan_id)
        counts["findings"] = fresh.count()
        counts["suppressed"] = found.select("fingerprint").distinct().count() - counts["findings"]
        sinks.append_snapshot(facts, entities, args.state, args.scan_id)
        known = state(spark, args.state).withColumn("doc_id", F.coalesce("old_document_id", "new_document_id"))
        made = report.build(known, fail_on, files=docs, totals={**counts}, fresh=fresh.select("fingerprint"), channels=channels)
        by_type = {r.drift_type: r.n for r in remember.counts_by(fresh, "drift_type").collect()}
    if args.out:
        _write(f"{args.out}/report.json", report.render_json(made))
        _write(f"{args.out}/report.html", report.render_html(made))
        pages = report.write_whole(known, f"{args.out}/pages", log=sinks.decisions(spark, args.state), channels=channels, files=docs)
        artifacts = {"drifts": found, "facts": facts, **({"channels": channels} if channels is not None else {})}
        for name, rows in artifacts.items():
            sinks.write_jsonl(rows, f"{args.out}/{name}")
        head = sinks.latest_snapshot(spark, args.state)
        said = {"scan_id": args.scan_id, "as_of": ctx.as_of.isoformat(), "fail_on": fail_on, "counts": counts, "pages": pages, "artifacts": sorted(artifacts), "facts": head.rows, "entities": head.entities, "knowledge_hash": head.knowledge_hash}
        _write(f"{args.out}/manifest.json", json.dumps(said, sort_keys=True, indent=2, ensure_ascii=False))
    print(f"{counts['findings']} new findings, {counts['suppressed']} known, {made['gate']['blocking']} blocking")
    print(", ".join(f"{n} {t}" for t, n in by_type.items() if n))
    return int(made["gate"]["failed"])


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    result = report.evaluation(golden.run_suite(spark, golden.load_cases(args.cases)))
    print(report.evaluation_text(result), end="")
    _write(args.output, json.dumps(result, sort_keys=True, indent=2, ensure_ascii=False))
    _write(args.markdown, report.evaluation_markdown(result))
    return 0 if result["total"]["passed"] else 1


def drift(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.action == "list":
        rows = remember.ordered(remember.listed(state(spark, args.state), None, args.status, args.type, args.scan), args.limit).collect()
        for r in rows:
            print(f"{r.fingerprint[:12]}  [{r.severity}] {r.drift_type}: {report.story(r.drift_type, json.loads(r.detail or '{}'))['title']}")
        print(f"{len(rows)} findings" if rows else "no findings")
        return 0
    found, fingerprint = one(spark, args.state, args.fingerprint)
    row = found.where(F.col("fingerprint") == fingerprint).first()
    if args.action == "show":
        for k, v in {**report.story(row.drift_type, json.loads(row.detail or "{}")), **row.asDict()}.items():
            if v is not None:
                print(f"{k}: {v}")
        return 0
    return _decide(spark, args.state, found, {"fingerprint": fingerprint, "action": "ignore", "reason": args.reason, "by": args.by})


def resolve(spark: SparkSession, args: argparse.Namespace) -> int:
    found, fingerprint = one(spark, args.state, args.fingerprint)
    return _decide(spark, args.state, found, {"fingerprint": fingerprint, "action": "resolve", "decision": args.decision, "authority_fact": args.authority_fact, "reason_code": args.reason_code, "reason": args.reason, "by": args.by})


def _decide(spark: SparkSession, root: str, found: DataFrame, entry: dict) -> int:
    """Append an entry to the decision log, if it would count."""
    drop = [c for c in ("status", "decision", "authority_fact", "reason_code", "decided_because") if c in found.columns]
    mine = spark.createDataFrame([tuple({"at": 2**62, **entry}.get(n.split()[0]) for n in sinks.DECISIONS_SCHEMA.split(", "))], sinks.DECISIONS_SCHEMA)
    own = sinks.decisions(spark, root).where(F.col("fingerprint") == entry["fingerprint"])
    judged = remember.judged_log(found.where(F.col("fingerprint") == entry["fingerprint"]).drop(*drop), own.unionByName(mine)).where(F.col("at") == 2**62).first()
    if judged.problem == "repeated":
        print(f"{entry['fingerprint'][:12]} is ignored already")
        return 0
    if judged.problem is not None:
        raise UserError(f"{entry['fingerprint'][:12]}: {judged.problem.replace('_', ' ')}")
    sinks.append_decision(spark, root, entry)
    print(f"{entry['fingerprint'][:12]} is now {'ignored' if entry['action'] == 'ignore' else 'resolved: ' + entry['decision']}")
    return 0


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    from factloom.plans.catalog import QUERIES

    if args.name not in QUERIES:
        raise UserError(f"there is no query {args.name}")
    QUERIES[args.name](spark, args.tables).show(20, truncate=40)
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="factloom")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, of=commands, **more) -> argparse.ArgumentParser:
        made = of.add_parser(name, **more)
        made.set_defaults(run=run)
        return made

    p = command("check", check, help="ingest a workspace")
    p.add_argument("workspace")
    for name in ("--state", "--output", "--html"):
        p.add_argument(name)
    p = command("scan", scan, help="detect, remember, report")
    p.add_argument("tables")
    p.add_argument("--state", required=True)
    p.add_argument("--scan-id", required=True)
    p.add_argument("--config")
    p.add_argument("--as-of")
    p.add_argument("--fail-on", choices=list(FAIL_ON_RANK))
    p.add_argument("--out")
    p.add_argument("--proposals", help="folder of proposed attribute clusters")
    p = command("eval", evaluate, help="run golden cases")
    p.add_argument("--cases", required=True)
    p.add_argument("--output")
    p.add_argument("--markdown")
    actions = commands.add_parser("drift", help="look at findings").add_subparsers(dest="action", required=True)
    p = command("list", drift, actions)
    p.add_argument("--status", default="open", choices=[*DRIFT_STATUS, "all"])
    p.add_argument("--type", choices=DRIFT_TYPES)
    p.add_argument("--scan")
    p.add_argument("--limit", type=int, default=200)
    p.add_argument("--state", required=True)
    p = command("show", drift, actions)
    p.add_argument("fingerprint")
    p.add_argument("--state", required=True)
    p = command("ignore", drift, actions)
    p.add_argument("fingerprint")
    p.add_argument("--state", required=True)
    p.add_argument("--reason")
    p.add_argument("--by", default=None)
    p = command("resolve", resolve, help="record a decision")
    p.add_argument("fingerprint")
    p.add_argument("--state", required=True)
    p.add_argument("--decision", required=True, help="|".join(DECISIONS))
    p.add_argument("--reason-code", help="|".join(REASON_CODES))
    p.add_argument("--reason")
    p.add_argument("--authority-fact")
    p.add_argument("--by", default=None)
    p = command("query", query, help="show the first rows of a query")
    p.add_argument("name")
    p.add_argument("tables")
    return out


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        if "by" in args and args.by is None:
            args.by = getpass.getuser()
        return args.run(SparkSession.getActiveSession() or build_session(), args)
    except Exception as error:  # the gate's answer must not be taken from a broken run
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
