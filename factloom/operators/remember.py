"""What happens to findings: suppression, decisions, status, gate, order, snapshots, roll-ups, scores."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators.evaluate import ratio
from factloom.rules import DECISIONS, DRIFT_STATUS, DRIFT_TYPES, FAIL_ON_RANK, REASON_CODES, SEVERITY_RANK


#: Columns of findings that are mostly digests, and sent as bytes.
IDS = ("fingerprint", "fact_id", "old_fact_id", "new_fact_id")


def new_findings(found: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose fingerprint is not known, whatever its status, once for each fingerprint."""
    fresh = X.with_packed(found, *IDS).join(X.with_packed(known.select("fingerprint"), "fingerprint").distinct(), "fingerprint", "left_anti")
    return X.with_unpacked(_first(fresh), *IDS).select(*found.columns)


def first_findings(found: DataFrame) -> DataFrame:
    """Each fingerprint once: of several rows the first by all that they say, so that a scan that runs again keeps the same one."""
    return X.with_unpacked(_first(X.with_packed(found, *IDS)), *IDS).select(*found.columns)


def _first(found: DataFrame) -> DataFrame:
    # maps have no order, but their entries have
    maps = {f.name for f in found.schema if f.dataType.typeName() == "map"}
    says = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in found.columns if c != "fingerprint"]
    if not says:
        return found.distinct()
    first = found.groupBy("fingerprint").agg(F.min(F.struct(*says)).alias("_row")).select("fingerprint", "_row.*")
    return first.withColumns({c: F.map_from_entries(c) for c in maps})


def suppressed_findings(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("fingerprint").distinct(), "fingerprint", "left_semi")


def authority_fact(decision: Column, old_fact: Column, new_fact: Column, explicit: Column | None = None) -> Column:
    """The fact that a decision declares right: the one it names, else the newer or the older as it says, else none."""
    implied = F.when(decision == "accept_newer", new_fact).when(decision == "keep_old", old_fact)
    return implied if explicit is None else F.coalesce(explicit, implied)


def judged_log(found: DataFrame, log: DataFrame) -> DataFrame:
    """The decision log ``(fingerprint, at, action, decision, authority_fact, reason_code, reason, by)`` with ``problem``: why an entry does not count.

    An entry must name a known finding, action, decision and reason code, and as authority
    one of the finding's facts. Of entries without such a fault the first decides: resolved
    findings stay so, ignored ones can no longer be resolved. Ignoring again changes nothing.
    """
    return X.with_unpacked(_judged(found, log), "fingerprint")


def _judged(found: DataFrame, log: DataFrame) -> DataFrame:
    """:func:`judged_log` with packed fingerprints."""
    has = lambda c, t: F.col(c) if c in found.columns else F.lit(None).cast(t)
    facts = found.select("fingerprint", F.lit(True).alias("_known"), has("old_fact_id", "string").cast("string").alias("_old"), has("new_fact_id", "string").cast("string").alias("_new"))
    lacks = {c: F.lit(None).cast("string") for c in ("decision", "authority_fact", "reason_code", "reason", "by") if c not in log.columns}
    sent = ("fingerprint", "authority_fact", "_old", "_new")
    x = X.with_unpacked(X.with_packed(log.withColumns(lacks), *sent).join(X.with_packed(facts, *sent).dropDuplicates(["fingerprint"]), "fingerprint", "left"), *sent[1:])
    resolves = F.col("action") == "resolve"
    named = F.col("authority_fact").isNotNull()
    fault = (
        F.when(F.col("_known").isNull(), "unknown_finding")
        .when(~F.col("action").isin("resolve", "ignore") | F.col("action").isNull(), "unknown_action")
        .when(resolves & (F.col("decision").isNull() | ~F.col("decision").isin(*DECISIONS)), "unknown_decision")
        .when(resolves & F.coalesce(~F.col("reason_code").isin(*REASON_CODES), F.lit(False)), "unknown_reason_code")
        .when(resolves & named & F.col("_old").isNull() & F.col("_new").isNull(), "no_facts_to_choose")
        .when(resolves & named & ~F.coalesce(F.col("authority_fact") == F.col("_old"), F.lit(False)) & ~F.coalesce(F.col("authority_fact") == F.col("_new"), F.lit(False)), "authority_not_of_finding")
    )
    x = x.withColumns({"_fault": fault, "_authority": F.when(resolves, authority_fact(F.col("decision"), F.col("_old"), F.col("_new"), F.col("authority_fact")))})
    order = Window.partitionBy("fingerprint", F.col("_fault").isNull()).orderBy("at", "action", "decision")
    x = x.withColumns({"_n": F.row_number().over(order), "_first": F.first("action").over(order)})
    later = F.when(F.col("_n") > 1, F.when((F.col("_first") == "ignore") & (F.col("action") == "ignore"), "repeated").otherwise(F.concat(F.lit("already_"), F.when(F.col("_first") == "ignore", "ignored").otherwise("resolved"))))
    x = x.withColumn("problem", F.coalesce("_fault", later))
    return x.withColumn("authority_fact", F.when(F.col("problem").isNull(), F.col("_authority")).otherwise(F.col("authority_fact"))).select("fingerprint", "at", "action", "decision", "authority_fact", "reason_code", "reason", "by", "problem")


def latest_status(found: DataFrame, log: DataFrame) -> DataFrame:
    """Findings with ``status, decision, authority_fact`` and the reason, as the entry of the log that counts leaves them."""
    good = _judged(found, log).where("problem is null").select("fingerprint", F.struct("action", "decision", "authority_fact", "reason_code", "reason").alias("d"))
    status = F.when(F.col("d.action") == "resolve", "resolved").when(F.col("d.action") == "ignore", "ignored").otherwise("open")
    x = X.with_unpacked(X.with_packed(found, *IDS).join(good, "fingerprint", "left"), *IDS).select(*found.columns, "d")
    return x.withColumns({"status": status, **{c: F.col(f"d.{c}") for c in ("decision", "authority_fact", "reason_code")}, "decided_because": F.col("d.reason")}).drop("d")


def blocking(found: DataFrame, fail_on: str) -> DataFrame:
    """How many open findings reach the threshold, and whether the gate fails; ``none`` never fails."""
    least = FAIL_ON_RANK[fail_on]
    hit = (F.col("status") == "open") & (X.severity_rank(F.col("severity")) >= least) & F.lit(least > 0)
    return found.agg(F.count_if(hit).alias("blocking")).withColumn("failed", F.col("blocking") > 0)


def ordered(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings by severity, then time, then id."""
    keys = [X.severity_rank(F.col("severity")).desc(), F.col("effective_at").asc_nulls_first(), F.col("fingerprint")]
    out = found.orderBy(*keys)
    return out.limit(limit) if limit else out


def listed(found: DataFrame, entities: DataFrame | None = None, status: str = "open", drift_type: str | None = None, scan_id: str | None = None) -> DataFrame:
    """Findings of one status (``all`` for any), type and scan, with the name of their subject."""
    if status not in (*DRIFT_STATUS, "all"):
        raise ValueError(f"status must be one of {', '.join(DRIFT_STATUS)}, all")
    if drift_type is not None and drift_type not in DRIFT_TYPES:
        raise ValueError(f"type must be one of {', '.join(DRIFT_TYPES)}")
    for column, value in (("status", None if status == "all" else status), ("drift_type", drift_type), ("scan_id", scan_id)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if entities is not None:
        names = entities.select(F.col("entity_id").cast("string").alias("_e"), F.col("name").alias("subject"))
        found = found.join(names, F.col("subject_id").cast("string") == F.col("_e"), "left").drop("_e")
    return found


def counts_by(found: DataFrame, column: str) -> DataFrame:
    """Counts for every value of a closed vocabulary, zeros included."""
    domain = {"drift_type": DRIFT_TYPES, "severity": tuple(SEVERITY_RANK), "status": DRIFT_STATUS}[column]
    names = found.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    n = found.groupBy(column).agg(F.count("*").alias("n"))
    return names.join(n, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def fact_records(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with ``record``: what a fact says as JSON with keys in order, without ids, times of scans or confidence.

    Subject and object are given by name and type; facts without a known subject have nulls there.
    """
    col = lambda c, t: F.col(c) if c in facts.columns else F.lit(None).cast(t)
    kind = entities.schema["entity_type"].dataType if "entity_type" in entities.columns else None
    named = entities.select(F.col("entity_id").cast("string").alias("_e"), F.col("name").alias("_n"), (F.col("entity_type") if kind else F.lit(None).cast("string")).alias("_t"))
    x = facts.withColumn("_s", F.col("subject_id").cast("string")).join(named.select(F.col("_e").alias("_s"), F.col("_n").alias("_sn"), F.col("_t").alias("_st")), "_s", "left")
    x = x.withColumn("_o", col("object_entity_id", "string")).join(named.select(F.col("_e").alias("_o"), F.col("_n").alias("_on"), F.col("_t").alias("_ot")), "_o", "left")
    text = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", ""), F.lit("null"))
    value = (
        F.when(F.col("object_type") == "number", X.number_text(col("object_number", "double")))
        .when(F.col("object_type") == "boolean", col("object_bool", "boolean").cast("string"))
        .when(F.col("object_type") == "date", text(F.date_format(col("object_date", "date"), "yyyy-MM-dd")))
        .otherwise(text(col("object_string", "string")))
    )
    parts = {
        "object_entity": text(F.col("_on")), "object_entity_type": text(F.col("_ot")), "object_type": text(F.col("object_type")), "object_value": F.coalesce(value, F.lit("null")), "predicate": text(F.col("predicate")),
        "status": text(F.coalesce(col("status", "string"), F.lit("active"))), "subject": text(F.col("_sn")), "subject_type": text(F.col("_st")), "valid_from": text(F.date_format("valid_from", "yyyy-MM-dd")), "valid_to": text(F.date_format("valid_to", "yyyy-MM-dd")),
    }
    fields = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]
    return x.withColumn("record", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))).drop("_s", "_sn", "_st", "_o", "_on", "_ot")


#: Bytes of lines that are packed as one.
PACK_BYTES = 4 << 20
#: Times that a line is written out at once.
REPEATS = 1_000


def knowledge_hash(records: DataFrame) -> DataFrame:
    """One hash of the records of :func:`fact_records`, in any order: SHA-256 of the sorted records, a line each.

    The definition is one sequence of bytes, so one task hashes the sorted lines. They are
    counted, sorted and packed before, by many tasks: equal lines are sent once with their
    number, and neighbours, which begin alike, are compressed together.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, lines, numbers, size, at = TaskContext.get().partitionId(), [], [], 0, 0

        def packed() -> pa.RecordBatch:
            blob = zlib.compress(b"\n".join(lines))
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "at": pa.array([at], pa.int64()), "lines": [blob], "numbers": pa.array([numbers], pa.list_(pa.int64()))})

        for batch in batches:
            for line, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines.append(line.encode())
                numbers.append(n)
                size += len(lines[-1])
                if size >= PACK_BYTES:
                    yield packed()
                    lines, numbers, size, at = [], [], 0, at + 1
        if lines:
            yield packed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = hashlib.sha256(), 0
        for batch in batches:
            for blob, numbers in zip(batch.column(0), batch.column(1), strict=True):
                # JSON escapes line ends, so none is within a record
                for line, n in zip(zlib.decompress(blob.as_py()).split(b"\n"), numbers.as_py(), strict=True):
                    line += b"\n"
                    while n > 0:
                        hashed.update(line * min(n, REPEATS))
                        n -= REPEATS
                total += sum(numbers.as_py())
        yield pa.RecordBatch.from_pydict({"hash": [hashed.hexdigest()], "n": [total]})

    counted = records.groupBy("record").agg(F.count("*").alias("n")).repartitionByRange("record").sortWithinPartitions("record")
    packs = counted.mapInArrow(pack, "task int, at bigint, lines binary, numbers array<bigint>")
    lines = packs.repartition(1).sortWithinPartitions("task", "at").select("lines", "numbers")
    # no rows may mean no task
    one = lines.mapInArrow(run, "hash string, n bigint").agg(F.max("hash").alias("h"), F.sum("n").alias("n"))
    return one.select(F.coalesce("h", F.lit(hashlib.sha256(b"").hexdigest())).alias("knowledge_hash"), F.coalesce("n", F.lit(0)).alias("facts"))


def snapshot_membership(facts: DataFrame) -> DataFrame:
    """What a snapshot holds: facts and subjects."""
    return facts.agg(F.count_distinct("fact_id").alias("facts"), F.count_distinct("subject_id").alias("entities"))


def snapshot_entities(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """``(entity_id)``: the entities that a snapshot holds, those that a fact is about or names as its object."""
    about = facts.select(F.col("subject_id").cast("string").alias("entity_id"))
    if "object_entity_id" in facts.columns:
        about = about.unionAll(facts.select(F.col("object_entity_id").cast("string")))
    return entities.select(F.col("entity_id").cast("string").alias("entity_id")).join(about, "entity_id", "left_semi").distinct()


#: Findings that are rolled up by document, and how many make a group; fixed values.
GROUPED_TYPES, GROUP_LEAST = ("confirmed_stale", "possibly_stale"), 2
SELF_DECLARED = "document_self_declared_expired"


def stale_groups(found: DataFrame, least: int = GROUP_LEAST) -> DataFrame:
    """Stale findings of one document and type as a group: how many, the highest severity, the first time."""
    g = found.groupBy("doc_id", "drift_type").agg(F.count("*").alias("issues"), F.max(X.severity_rank(F.col("severity"))).alias("r"), F.min("effective_at").alias("first_effective_at"))
    return g.where(F.col("issues") >= least).select("doc_id", "drift_type", "issues", X.severity_name(F.col("r")).alias("severity"), "first_effective_at")


def roll_up(found: DataFrame, least: int = GROUP_LEAST) -> tuple[DataFrame, DataFrame]:
    """Groups ``(doc_id, drift_type, head, issues, severity, first_effective_at, fingerprints)``, and the findings that stay by themselves.

    ``found`` has ``doc_id, reason``. A document's card of its own expiry heads one group with
    all stale findings of the document, single ones too, under the card's severity; without
    one, findings of a type are a group from ``least`` of them.
    """
    grouped = F.col("drift_type").isin(*GROUPED_TYPES) & F.col("doc_id").isNotNull()
    head = F.coalesce(F.col("reason") == SELF_DECLARED, F.lit(False)) & grouped
    cards = found.where(head).groupBy("doc_id").agg(F.min_by(F.struct("fingerprint", "severity"), "fingerprint").alias("card"))
    x = found.withColumn("_g", grouped).join(cards, "doc_id", "left")
    x = x.withColumn("_key", F.when(F.col("_g"), F.when(F.col("card").isNotNull(), F.lit(SELF_DECLARED)).otherwise(F.col("drift_type"))))
    g = x.where("_key is not null").groupBy("doc_id", "_key").agg(
        F.count("*").alias("issues"), F.max(X.severity_rank(F.col("severity"))).alias("r"), F.min("effective_at").alias("first_effective_at"), F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"), F.first("card").alias("card")
    )  # bounded by the findings of one document
    g = g.where((F.col("_key") == SELF_DECLARED) | (F.col("issues") >= least))
    declared = F.col("_key") == SELF_DECLARED
    groups = g.select("doc_id", F.when(declared, "confirmed_stale").otherwise(F.col("_key")).alias("drift_type"), F.when(declared, F.col("card.fingerprint")).alias("head"), "issues", F.when(declared, F.col("card.severity")).otherwise(X.severity_name(F.col("r"))).alias("severity"), "first_effective_at", "fingerprints")
    alone = x.join(g.select("doc_id", "_key", F.lit(True).alias("_in")), ["doc_id", "_key"], "left").where("_in is null").select(*found.columns)
    return groups, alone


def first_evidence(evidence: DataFrame) -> DataFrame:
    """The first of each (chunk_id, quote), in the order of ``ord``."""
    w = Window.partitionBy("chunk_id", "quote").orderBy("ord")
    return evidence.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rates(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 from rows with boolean ``expected`` and ``found``; a zero denominator gives 0."""
    tp, fp, fn = F.count_if(F.col("expected") & F.col("found")), F.count_if(~F.col("expected") & F.col("found")), F.count_if(F.col("expected") & ~F.col("found"))
    x = pairs.groupBy(*(by or [])).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    x = x.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
