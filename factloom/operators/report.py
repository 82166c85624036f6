"""Reports: the first page of findings with groups, counts, gate and review items, as JSON and as one HTML file; all of them in pages; and reports of golden runs."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import remember
from factloom.ordering import numbered
from factloom.rules import CHANNELS, DRIFT_STATUS


@dataclass(frozen=True)
class Story:
    """What a finding means for its reader: a title with places for names, why it was found, what to do, and likely decisions."""

    title: str
    why: str
    advice: str
    decisions: tuple[str, ...]


_CONFLICT = Story("{subject}: {predicate} differs between sources", "Two sources that are both in force give different values for the same thing: {old_value} and {new_value}.", "Find out which source is right and correct the other one.", ("accept_newer", "keep_old", "manual_override"))
_ENDED = Story("{subject}: {predicate} has run out", "The source itself says that this was valid until {valid_to}.", "Renew the statement or take it out of use.", ("accept_newer", "false_positive"))
_REPLACED = Story("{subject}: {predicate} comes from a replaced edition", "{old_source} has been replaced by {new_source}.", "Use what the newer edition says.", ("accept_newer", "false_positive"))
_BOTH = Story("{subject}: {predicate} has run out and its source is replaced", "It was valid until {valid_to}, and {old_source} has been replaced by {new_source}.", "Use what the newer edition says.", ("accept_newer",))
_DECLARED = Story("{source} says that it is no longer valid", "The document states its own end: {valid_to}. Everything it says is affected.", "Replace the document, or declare its successor.", ("accept_newer", "keep_old"))
_INFERRED = Story("{subject}: {predicate} may have run out", "An end on {valid_to} was taken from its surroundings, not from the statement.", "Check whether the statement still holds.", ("keep_old", "accept_newer"))
_AGED = Story("{subject}: {predicate} has not been confirmed for {age_days} days", "Nobody has confirmed this within the time that its kind of source allows.", "Check it and record the date of the check.", ("keep_old", "accept_newer"))
_REUSED = Story("{subject}: {predicate} repeats a replaced value", "{reused_value} {unit} was given up by the current edition, which says {head_value}; {source} still has it.", "Correct the source that repeats the old value.", ("accept_newer", "false_positive"))
_SUPERSEDED = Story("{old_source} is replaced by {new_source}", "The list of versions says so.", "Take the old edition out of circulation.", ("accept_newer",))
_DUPLICATE = Story("{entity_a} and {entity_b} are likely one thing", "They share {shared_fact_count} facts, and their names or vectors are alike ({recall}).", "Merge them, or mark them as different.", ("manual_override", "false_positive"))

#: The story of each type and reason; a type alone is the fallback.
STORIES = {
    ("conflict", None): _CONFLICT,
    ("confirmed_stale", "valid_to_expired"): _ENDED,
    ("confirmed_stale", "superseding_source"): _REPLACED,
    ("confirmed_stale", "valid_to_expired+superseding_source"): _BOTH,
    ("confirmed_stale", remember.SELF_DECLARED): _DECLARED,
    ("confirmed_stale", None): _ENDED,
    ("possibly_stale", "inferred_validity_expired"): _INFERRED,
    ("possibly_stale", None): _AGED,
    ("reused_stale_value", None): _REUSED,
    ("superseded", None): _SUPERSEDED,
    ("duplicate", None): _DUPLICATE,
}


class _Named(dict):
    def __missing__(self, key: str) -> str:
        return "?"


def story(drift_type: str, detail: dict) -> dict:
    """Title, reason, advice and decisions for a finding, with what its detail names filled in."""
    s = STORIES.get((drift_type, detail.get("reason"))) or STORIES[drift_type, None]
    known = _Named({k: v for k, v in detail.items() if v is not None})
    return {"title": s.title.format_map(known), "why": s.why.format_map(known), "recommendation": s.advice.format_map(known), "suggested_decisions": list(s.decisions)}


def group_story(group: dict, filename: str) -> dict:
    """The same for a group of one document."""
    if group["head"] is not None:
        return {"title": f"{filename} says that it is no longer valid", "why": f"{group['issues']} findings follow from the document's own end.", "recommendation": _DECLARED.advice, "suggested_decisions": list(_DECLARED.decisions)}
    word = "out of date" if group["drift_type"] == "confirmed_stale" else "perhaps out of date"
    return {"title": f"{filename}: {group['issues']} statements are {word}", "why": "They share one document, so one decision may settle them.", "recommendation": "Review the document as a whole.", "suggested_decisions": ["accept_newer", "keep_old"]}


def build(found: DataFrame, fail_on: str = "critical", page: int = 200, files: DataFrame | None = None, channels: DataFrame | None = None, totals: dict | None = None, fresh: DataFrame | None = None) -> dict:
    """A report of findings ``drift_type, severity, status, effective_at, fingerprint`` and, if there, ``doc_id, reason, detail``.

    Counts are over all findings; open ones are rolled up by document, and the first
    ``page`` groups and single findings are given in full. ``files`` names documents
    ``(doc_id, filename)``, ``channels`` are review items, ``fresh`` the fingerprints that
    this scan found first, ``totals`` counts and hashes to pass on.
    """
    null = F.lit(None).cast("string")
    lacks = {c: F.lit("open") if c == "status" else null for c in ("status", "doc_id", "reason", "detail") if c not in found.columns}
    found = found.withColumns(lacks) if lacks else found
    opened = found.where("status = 'open'")
    gate = remember.blocking(found, fail_on).first()
    counts = {c: {r[c]: r.n for r in remember.counts_by(opened, c).collect()} for c in ("drift_type", "severity")}
    status = {r.status: r.n for r in remember.counts_by(found, "status").collect()}
    groups, alone = remember.roll_up(opened.withColumn("doc_id", F.col("doc_id").cast("string")))
    names = files.select(F.col("doc_id").cast("string").alias("doc_id"), "filename") if files is not None else None
    shown = groups.join(names, "doc_id", "left") if names is not None else groups.withColumn("filename", F.col("doc_id"))
    order = [remember.X.severity_rank(F.col("severity")).desc(), F.col("first_effective_at").asc_nulls_first(), "filename", "doc_id", "drift_type"]
    n_groups = groups.count()
    new = {r.fingerprint for r in fresh.join(remember.ordered(alone, page).select("fingerprint"), "fingerprint", "left_semi").collect()} if fresh is not None else None
    items = []
    for r in remember.ordered(alone, page).collect():
        x = r.asDict(recursive=True)
        detail = json.loads(x.pop("detail") or "{}") | {"reason": x["reason"]}
        items.append({**story(r.drift_type, detail), **x, "detail": detail, **({"new_this_scan": r.fingerprint in new} if new is not None else {})})
    folders = [{**group_story(r.asDict(), r.filename or str(r.doc_id)), **r.asDict(recursive=True)} for r in shown.orderBy(*order).limit(page).collect()]
    review = {kind: [] for kind in CHANNELS}
    if channels is not None:
        for r in channels.orderBy("kind", "subject_id", "fact_a", "fact_b").limit(page).collect():
            review[r.kind].append({k: v for k, v in r.asDict(recursive=True).items() if k != "kind"})
    return {
        "totals": totals or {}, "by_type": counts["drift_type"], "by_severity": counts["severity"], "by_status": {s: status[s] for s in DRIFT_STATUS}, "gate": {"fail_on": fail_on, "blocking": gate.blocking, "failed": gate.failed},
        "groups_total": n_groups, "groups": folders, "items": items, "shown": len(items), "review": review,
    }


#: Rows of a page.
PAGE = 1_000


def write_pages(rows: DataFrame, order: list, path: str, page: int = PAGE) -> int:
    """Write all ``rows`` as JSON lines in pages, ``page=0`` and on, each in its ``place``; returns how many rows there are.

    Executors write the pages, so nothing is left out however many rows there are.
    """
    x = numbered(rows, order, "place", "report-pages").withColumn("page", F.floor(F.col("place") / page))
    x = x.repartitionByRange("page", "place").sortWithinPartitions("page", "place")
    x.write.mode("overwrite").partitionBy("page").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.json(path, schema="place bigint").count()


def write_whole(found: DataFrame, path: str, evidence: DataFrame | None = None, log: DataFrame | None = None, channels: DataFrame | None = None, files: DataFrame | None = None, page: int = PAGE) -> dict:
    """The whole report as pages in the folders ``findings``, ``groups`` and ``review`` of ``path``; returns what each holds.

    Every finding is in some page with what it says, its ``evidence`` quotes ``(fact_id,
    quote, filename)``, old before new and each once, and its decisions ``(fingerprint, at,
    action, decision, reason)`` in their order. Groups name their findings. ``found`` is as
    :func:`build` takes it.
    """
    null = F.lit(None).cast("string")
    lacks = {c: F.lit("open") if c == "status" else null for c in ("status", "doc_id", "reason", "detail", "old_fact_id", "new_fact_id") if c not in found.columns}
    found = found.withColumns(lacks) if lacks else found
    x = found.select("*")
    if evidence is not None:
        asked = x.select("fingerprint", F.posexplode(F.array("old_fact_id", "new_fact_id")).alias("side", "fact_id")).where("fact_id is not null")
        quotes = asked.join(evidence.select("fact_id", "quote", "filename"), "fact_id").groupBy("fingerprint", "quote", "filename").agg(F.min("side").alias("side"))
        quotes = quotes.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("side", "filename", "quote"))).alias("evidence"))  # of two facts
        x = x.join(quotes, "fingerprint", "left")
    if log is not None:
        known = [c for c in ("at", "action", "decision", "reason", "by") if c in log.columns]
        x = x.join(log.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct(*known))).alias("decisions")), "fingerprint", "left")  # of one finding
    ranked = [remember.X.severity_rank(F.col("severity")).desc(), F.col("effective_at").asc_nulls_first(), F.col("fingerprint").asc()]
    held = {"findings": write_pages(x, ranked, f"{path}/findings", page)}
    groups, _ = remember.roll_up(found.where("status = 'open'").withColumn("doc_id", F.col("doc_id").cast("string")))
    if files is not None:
        groups = groups.join(files.select(F.col("doc_id").cast("string").alias("doc_id"), "filename"), "doc_id", "left")
    held["groups"] = write_pages(groups, [remember.X.severity_rank(F.col("severity")).desc(), F.col("first_effective_at").asc_nulls_first(), F.col("doc_id").asc(), F.col("drift_type").asc()], f"{path}/groups", page)
    if channels is not None:
        held["review"] = write_pages(channels, [F.col(c).asc_nulls_first() for c in ("kind", "subject_id", "fact_a", "fact_b")], f"{path}/review", page)
    return {"page": page, "rows": held}


def _plain(value):
    return value.isoformat() if isinstance(value, (date, datetime)) else str(value)


def render_json(report: dict) -> str:
    return json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False, default=_plain)


def render_html(report: dict) -> str:
    """One self-contained page; every value is escaped."""
    esc = lambda v: html.escape("" if v is None else _plain(v))
    table = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    gate = report["gate"]
    section = lambda i: f"<section class='{esc(i['severity'])}'><h3>{esc(i['title'])}</h3><p>{esc(i.get('why'))}</p><p>{esc(i.get('recommendation'))}</p>{table(sorted((k, v) for k, v in i.items() if k not in ('title', 'why', 'recommendation')))}</section>"
    review = "".join(f"<h3>{esc(kind)}</h3>{table([[x.get('reason'), x.get('subject_id'), x.get('value_a'), x.get('value_b')] for x in rows])}" for kind, rows in report.get("review", {}).items() if rows)
    return (
        "<!doctype html><meta charset='utf-8'><title>Knowledge drift</title><style>body{font:15px sans-serif;margin:2em}td{padding:2px 8px;border-top:1px solid #ddd}.critical h3{color:#a00}</style>"
        f"<h1>Knowledge drift</h1><p>Gate at {esc(gate['fail_on'])}: {'failed' if gate['failed'] else 'passed'}, {esc(gate['blocking'])} blocking</p>{table(report.get('totals', {}).items())}"
        f"<h2>By type</h2>{table(report['by_type'].items())}<h2>By severity</h2>{table(report['by_severity'].items())}"
        f"<h2>Documents</h2>{''.join(map(section, report.get('groups', [])))}<h2>First {report['shown']}</h2>{''.join(map(section, report['items']))}"
        + (f"<h2>For review</h2>{review}" if review else "")
    )


def evaluation(suite) -> dict:
    """A golden run as plain values: totals with the gate, by type, by category, and what was missed or not expected."""
    rows = lambda frame, *order: [r.asDict() for r in frame.orderBy(*order).collect()]
    return {
        "total": suite.total.first().asDict(),
        "by_type": rows(suite.by_type, "drift_type"),
        "by_category": rows(suite.by_category, "category"),
        "failed": rows(suite.cases.where("not passed"), "case_id"),
        "missed": rows(suite.missed, "case_id", "expected_id"),
        "unexpected": rows(suite.unexpected, "case_id", "finding_id"),
    }


def _shares(total: dict) -> str:
    return f"precision {total['precision']:.4f}, recall {total['recall']:.4f}, F1 {total['f1']:.4f}, false alarms {total['false_positive_rate']:.4f}"


def _told(x: dict) -> str:
    return f"{x['case_id']}: {x['drift_type']} " + ", ".join(f"{k} {x[k]}" for k in ("subject_id", "predicate", "severity", "old_source", "new_source", "target") if x.get(k) is not None)


def evaluation_text(result: dict) -> str:
    """A golden run for a terminal."""
    total = result["total"]
    lines = [f"{total['passed_cases']} of {total['cases']} cases pass; found {total['tp']}, missed {total['fn']}, not expected {total['fp']}", _shares(total)]
    lines += [f"  {t['drift_type']}: expected {t['expected']}, found {t['tp']}, missed {t['fn']}, not expected {t['fp']}" for t in result["by_type"]]
    lines += [f"missed {_told(x)}" for x in result["missed"]] + [f"not expected {_told(x)}" for x in result["unexpected"]]
    return "\n".join([*lines, f"gate {'passed' if total['passed'] else 'failed'}"]) + "\n"


def evaluation_markdown(result: dict) -> str:
    """A golden run as Markdown."""
    total = result["total"]
    cell = lambda v: str(v).replace("|", "\\|")
    table = lambda names, rows: "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(round(r[n], 4) if isinstance(r[n], float) else r[n]) for n in names) + " |" for r in rows)])
    parts = [f"# Golden run\n\nGate {'passed' if total['passed'] else 'failed'}: {_shares(total)}.", f"## By type\n\n{table(['drift_type', 'expected', 'tp', 'fp', 'fn', 'precision', 'recall'], result['by_type'])}", f"## By category\n\n{table(['category', 'cases', 'passed', 'fp'], result['by_category'])}"]
    for name, rows in (("Missed", result["missed"]), ("Not expected", result["unexpected"])):
        if rows:
            parts.append(f"## {name}\n\n" + "\n".join(f"* {cell(_told(x))}" for x in rows))
    return "\n\n".join(parts) + "\n"
