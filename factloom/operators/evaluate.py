"""Scoring findings against expectations: matching within a case, rates, gate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import ship_package

LOCATORS = ("subject_id", "predicate", "severity", "old_source", "new_source", "target")
#: Fixed values.
GATE = {"precision": 0.80, "recall": 0.70, "f1": 0.75, "false_positive_rate": 0.30}
MATCH_SCHEMA = "case_id string, expected_id string, finding_id string"


def _match(found: pd.DataFrame) -> pd.DataFrame:
    """Greedy: the most specific expectation first, candidates in order, each used once."""
    taken, rows = set(), []
    wanted = found[["case_id", "expected_id", "locators", "wish"]].drop_duplicates().sort_values(["locators", "wish"], ascending=[False, True])
    for case_id, expected_id in wanted[["case_id", "expected_id"]].itertuples(index=False):
        options = found[(found.expected_id == expected_id) & found.finding_id.notna()].sort_values("place").finding_id
        hit = next((x for x in options if x not in taken), None)
        if hit is not None:
            taken.add(hit)
        rows.append((case_id, expected_id, hit))
    return pd.DataFrame(rows, columns=["case_id", "expected_id", "finding_id"])


def match_findings(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``(case_id, expected_id, finding_id)``: which finding satisfies each expectation, null if none is left.

    Pairs that satisfy each other are joined in Spark; the greedy choice runs case by
    case, and a case is a handful of rows. Expectations go by number of locators, type,
    predicate, subject and place; findings by predicate, subject, severity and id.
    """
    ship_package(found.sparkSession)
    e, f = expected.alias("e"), found.alias("f")
    on = (F.col("e.case_id") == F.col("f.case_id")) & (F.col("e.drift_type") == F.col("f.drift_type"))
    for name in LOCATORS:
        wanted, got = F.col(f"e.{name}"), F.col(f"f.{name}")
        if name == "predicate":
            wanted, got = F.lower(wanted), F.lower(F.coalesce(got, F.lit("")))
        on &= wanted.isNull() | F.coalesce(wanted == got, F.lit(False))
    locators = sum((F.col(f"e.{n}").isNotNull().cast("int") for n in LOCATORS), F.lit(0))
    in_order = lambda s, *names: F.concat_ws("\u0001", *[F.coalesce(F.col(f"{s}.{n}"), F.lit("")) for n in names])
    pairs = e.join(f, on, "left").select(
        F.col("e.case_id").alias("case_id"), F.col("e.expected_id").alias("expected_id"), locators.alias("locators"), in_order("e", "drift_type", "predicate", "subject_id", "expected_id").alias("wish"),
        F.col("f.finding_id").alias("finding_id"), in_order("f", "predicate", "subject_id", "severity", "finding_id").alias("place"),
    )
    return pairs.groupBy("case_id").applyInPandas(_match, MATCH_SCHEMA)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 for nothing."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def _rated(counts: DataFrame) -> DataFrame:
    """Counts ``tp, fp, fn`` with precision, recall and F1."""
    x = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def suite_metrics(names: DataFrame, wanted: DataFrame, missed: DataFrame, found: DataFrame, unexpected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows by case, total with the gate, by drift type, and by category, of cases ``names`` ``(case_id, category)``.

    A benign case raises a false alarm if anything at all is found in it.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    count = lambda frame, by, name: frame.groupBy(by).agg(F.count("*").alias(name))
    per = names
    for frame, name in ((wanted, "wanted"), (missed, "fn"), (unexpected, "fp"), (found, "found")):
        per = per.join(count(frame, "case_id", name), "case_id", "left")
    per = per.select("case_id", "category", (zero("wanted") - zero("fn")).alias("tp"), zero("fp").alias("fp"), zero("fn").alias("fn"), zero("found").alias("found"))
    per = per.withColumn("passed", (F.col("fp") == 0) & (F.col("fn") == 0))
    benign = F.col("category") != "positive"
    total = per.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed_cases"), zero(F.sum("tp")).alias("tp"), zero(F.sum("fp")).alias("fp"), zero(F.sum("fn")).alias("fn"),
        F.count_if(benign).alias("benign"), F.count_if(benign & (F.col("found") > 0)).alias("false_alarms"),
    )
    total = gate(_rated(total).withColumn("false_positive_rate", ratio(F.col("false_alarms"), F.col("benign"))))
    types = wanted.select("drift_type").unionAll(unexpected.select("drift_type")).distinct()
    for frame, name in ((wanted, "expected"), (missed, "fn"), (unexpected, "fp")):
        types = types.join(count(frame, "drift_type", name), "drift_type", "left")
    types = types.select("drift_type", zero("expected").alias("expected"), (zero("expected") - zero("fn")).alias("tp"), zero("fp").alias("fp"), zero("fn").alias("fn"))
    alarms = unexpected.join(names, "case_id").groupBy("category").agg(F.count("*").alias("fp"))
    categories = per.groupBy("category").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed")).join(alarms, "category", "left").select("category", "cases", "passed", zero("fp").alias("fp"))
    return per, total, _rated(types), categories


def gate(metrics: DataFrame) -> DataFrame:
    """Metrics ``tp, fn, benign, precision, recall, f1, false_positive_rate`` with ``passed``: every rate strictly beyond its threshold, and cases of both kinds."""
    ok = (F.col("precision") > GATE["precision"]) & (F.col("recall") > GATE["recall"]) & (F.col("f1") > GATE["f1"]) & (F.col("false_positive_rate") < GATE["false_positive_rate"])
    return metrics.withColumn("passed", ok & (F.col("tp") + F.col("fn") > 0) & (F.col("benign") > 0))


#: The share of reported findings that people must confirm; a fixed value.
CONFIRMED_GATE = 0.60


def confirmed_rate(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of reported findings ``(drift_type, verdict, actionable)``, how many people confirmed and could act on, and whether that passes."""
    confirmed = F.coalesce(F.col("verdict") == "confirmed", F.lit(False))
    out = labels.groupBy(*(["drift_type"] if by is None else by)).agg(
        F.count("*").alias("reported"), F.count_if(confirmed).alias("confirmed"), F.avg(confirmed.cast("double")).alias("confirmed_rate"), F.avg(F.col("actionable").cast("double")).alias("actionable_rate")
    )
    return out.withColumn("passed", F.col("confirmed_rate") > CONFIRMED_GATE)


def false_positive_tally(labels: DataFrame) -> DataFrame:
    """``(drift_type, verdict, n)`` of the reported findings that people did not confirm, by what they said instead."""
    return labels.where("verdict is null or verdict <> 'confirmed'").groupBy("drift_type", F.coalesce("verdict", F.lit("unjudged")).alias("verdict")).agg(F.count("*").alias("n"))


def planted_recall(planted: DataFrame, labels: DataFrame) -> DataFrame:
    """``(planted, found, recall)``: how many planted scenarios ``(scenario)`` any confirmed finding ``(scenario, verdict)`` belongs to."""
    hit = labels.where("verdict = 'confirmed'").select("scenario").distinct().withColumn("hit", F.lit(1))
    x = planted.select("scenario").distinct().join(hit, "scenario", "left").agg(F.count("*").alias("planted"), F.count("hit").alias("found"))
    return x.withColumn("recall", ratio(F.col("found"), F.col("planted")))
