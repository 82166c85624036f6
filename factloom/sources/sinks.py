"""Sinks: append-only findings, snapshots, artifacts and scan audits, published by a manifest row once they are complete.

Rows are written to a fresh folder and count only once a manifest row names that folder.
Writing a scan id again publishes another folder in its place: what other scans know is
suppressed, what the scan itself stored before is not, so a repeated scan stores the same rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.remember import fact_records, first_findings, knowledge_hash, new_findings, snapshot_entities

MANIFEST = "scan_id string, table string, folder string, at bigint, rows bigint, entities bigint, knowledge_hash string, parent string"
AUDIT = "scan_id string, status string, at bigint, findings bigint, suppressed bigint, error string"
#: Characters kept of an error in the audit; a fixed value.
ERROR_CHARS = 4000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of a folder; none if it is not there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The last manifest row of each scan of a table."""
    rows = _read(spark, f"{root}/_manifest", MANIFEST).where(F.col("table") == name)
    return rows.groupBy("scan_id").agg(F.max_by(F.struct(*[f.name for f in rows.schema if f.name != "scan_id"]), "at").alias("m")).select("scan_id", "m.*")


def published(spark: SparkSession, root: str, name: str) -> list[str]:
    """Scans whose rows of a table are complete, in the order of their publication; broken scans are not among them."""
    return [r.scan_id for r in manifest(spark, root, name).orderBy("at", "scan_id").collect()]


def stored_rows(spark: SparkSession, root: str, name: str, without: str | None = None) -> DataFrame | None:
    """The published rows of a table with their ``scan_id``, but for one scan; None if there are none."""
    rows = [r for r in manifest(spark, root, name).collect() if r.scan_id != without]
    if not rows:
        return None
    folders = spark.createDataFrame([(r.folder.rsplit("/", 1)[-1], r.scan_id) for r in rows], "_f string, scan_id string")
    read = spark.read.parquet(*[r.folder for r in rows]).withColumn("_f", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1))
    return read.join(folders, "_f").drop("_f")


def _publish(spark: SparkSession, root: str, row: dict) -> None:
    names = [p.split()[0] for p in MANIFEST.split(", ")]
    full = {"at": time.time_ns(), **row}
    spark.createDataFrame([tuple(full.get(n) for n in names)], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/_manifest")


def _fresh(root: str, name: str) -> str:
    return f"{root}/{name}/{uuid.uuid4().hex}"


def append_findings(found: DataFrame, root: str, scan_id: str) -> DataFrame:
    """Append the findings that no other published scan knows, and return them as stored."""
    spark = found.sparkSession
    known = stored_rows(spark, root, "findings", without=scan_id)
    fresh = new_findings(found, known) if known is not None else first_findings(found)
    folder = _fresh(root, "findings")
    fresh.write.parquet(folder)
    out = spark.read.parquet(folder)
    _publish(spark, root, {"scan_id": scan_id, "table": "findings", "folder": folder, "rows": out.count()})
    return out


def append_snapshot(facts: DataFrame, entities: DataFrame, root: str, scan_id: str) -> str:
    """Append the membership of a snapshot, with its counts, time, hash and the snapshot before it; returns the hash."""
    spark = facts.sparkSession
    before = latest_snapshot(spark, root, without=scan_id)
    folder, things = _fresh(root, "snapshot_facts"), _fresh(root, "snapshot_entities")
    facts.select("fact_id", "subject_id").write.parquet(folder)
    snapshot_entities(facts, entities).write.parquet(things)
    row = knowledge_hash(fact_records(facts, entities)).first()
    held = spark.read.parquet(folder).agg(F.count_distinct("subject_id")).first()[0]
    _publish(spark, root, {"scan_id": scan_id, "table": "snapshot_entities", "folder": things, "rows": spark.read.parquet(things).count()})
    _publish(spark, root, {"scan_id": scan_id, "table": "snapshot_facts", "folder": folder, "rows": row.facts, "entities": held, "knowledge_hash": row.knowledge_hash, "parent": before.scan_id if before else None})
    return row.knowledge_hash


def latest_snapshot(spark: SparkSession, root: str, without: str | None = None):
    """The header of the last published snapshot, or None."""
    rows = manifest(spark, root, "snapshot_facts")
    return (rows.where(F.col("scan_id") != without) if without is not None else rows).orderBy(F.col("at").desc(), F.col("scan_id").desc()).first()


def publish_ingest(spark: SparkSession, root: str, documents: DataFrame, chunks: DataFrame, files: DataFrame) -> None:
    """Publish what a check of a workspace has parsed: its documents, their chunks and the listing of its files, by one manifest row.

    A check that stops before that row leaves nothing behind that is read, so no file
    counts as parsed whose chunks were never stored.
    """
    folder = _fresh(root, "ingest")
    documents.write.parquet(f"{folder}/documents")
    chunks.write.parquet(f"{folder}/chunks")
    files.write.parquet(f"{folder}/files")
    _publish(spark, root, {"scan_id": folder.rsplit("/", 1)[-1], "table": "ingest", "folder": folder, "rows": spark.read.parquet(f"{folder}/documents").count()})


def ingested(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """All documents as the last published check left them, the chunks of all checks, and the last listing of files; None before the first."""
    folders = [r.folder for r in manifest(spark, root, "ingest").orderBy("at", "scan_id").collect()]
    if not folders:
        return None
    return spark.read.parquet(f"{folders[-1]}/documents"), spark.read.parquet(*[f"{f}/chunks" for f in folders]), spark.read.parquet(f"{folders[-1]}/files")


def append_decision(spark: SparkSession, root: str, decision: dict) -> None:
    """Append one entry of the decision log."""
    names = [p.split()[0] for p in DECISIONS_SCHEMA.split(", ")]
    full = {"at": time.time_ns(), **decision}
    spark.createDataFrame([tuple(full.get(n) for n in names)], DECISIONS_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/_decisions")


DECISIONS_SCHEMA = "fingerprint string, at bigint, action string, decision string, authority_fact string, reason_code string, reason string, by string"


def decisions(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/_decisions", DECISIONS_SCHEMA)


@contextmanager
def audited(spark: SparkSession, root: str, scan_id: str) -> Iterator[dict]:
    """Audit rows of a scan: running at its start, then completed with the counts put in, or failed with its error."""

    def put(status: str, counts: dict, error: str | None = None) -> None:
        row = (scan_id, status, time.time_ns(), counts.get("findings"), counts.get("suppressed"), error and error[:ERROR_CHARS])
        spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").json(f"{root}/_audit")

    counts: dict = {}
    put("running", counts)
    try:
        yield counts
    except Exception as error:
        put("failed", counts, str(error))
        raise
    put("completed", counts)


def audit(spark: SparkSession, root: str) -> DataFrame:
    """The last audit row of each scan."""
    rows = _read(spark, f"{root}/_audit", AUDIT)
    return rows.groupBy("scan_id").agg(F.max_by(F.struct("status", "at", "findings", "suppressed", "error"), "at").alias("a")).select("scan_id", "a.*")


def write_jsonl(frame: DataFrame, path: str) -> None:
    """An artifact of JSON lines; nulls are kept, so every line has all fields."""
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines of an artifact; a line that is no JSON fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)
