"""Knowledge frames from the star schema, so that every operator has data and an oracle.

Documents are a supplier's editions by year; suppliers with even keys declare which
edition each replaces. Facts are line items about parts; entities are parts.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.exprs import canonical_object
from factloom.rules import RuleContext
from factloom.session import table

#: The rules that the queries over these frames use.
RULES = RuleContext(as_of=date(2001, 6, 1), pricing_stale_days=90, severity={"pricing_change": "critical", "policy_change": "medium"}, immutable=frozenset())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    editions = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y")).distinct()
    doc = F.col("s") * 10000 + F.col("y")
    even = F.col("s") % 2 == 0
    before = F.lag(doc).over(Window.partitionBy("s").orderBy("y"))
    return editions.select(
        doc.alias("doc_id"),
        F.when(even, F.col("s")).alias("group_id"),
        F.when(even, before).alias("prev_id"),
        F.concat(F.lit("s"), F.col("s"), F.lit("_"), F.col("y"), F.lit(".csv")).alias("filename"),
        F.when(F.col("s") % 3 == 0, "pricing").when(F.col("s") % 3 == 1, "policy").otherwise("crm").alias("source_type"),
        ((F.col("s") % 20 + 80) / 100).alias("authority"),
        F.make_date("y", F.lit(12), F.lit(31)).alias("parsed_at"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    day = F.col("l_shipdate").cast("date")
    key = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus", day)
    null = F.lit(None).cast("string")
    anchor = F.col("l_linenumber") % 3
    return x.select(
        F.sha2(key, 256).alias("fact_id"),
        F.col("l_partkey").alias("subject_id"),
        F.concat(F.lit("Qty_"), "l_returnflag").alias("predicate"),
        F.lower(F.concat(F.lit("Qty_"), "l_returnflag")).alias("pred_fold"),
        F.lit("number").alias("object_type"),
        F.col("l_quantity").alias("object_number"),
        canonical_object(F.lit("number"), null, F.col("l_quantity"), null.cast("date"), null.cast("boolean"), null).alias("canon_object"),
        F.when(F.col("l_linestatus") == "O", "Box").otherwise("unit").alias("measure_unit"),
        (F.col("l_suppkey") * 10000 + F.year("l_shipdate")).alias("doc_id"),
        day.alias("valid_from"),
        F.when(cents("l_discount") >= 5, F.date_add(day, 730)).alias("valid_to"),
        F.when(anchor == 0, "quoted").when(anchor == 1, "document_scope").alias("valid_to_anchor"),
        F.lit(None).cast("date").alias("observed_at"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), "embedding")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.lit("part").alias("entity_type")).join(vectors, "entity_id", "left")


def entity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(subject_id, pred_fold, canon_object)``: what is known of each part."""
    p = table(spark, sf_dir, "part")
    pairs = [("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size").cast("string")), ("price", F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string"))]
    each = F.array(*[F.struct(F.lit(n).alias("pred_fold"), F.concat(F.lit("scalar|"), v).alias("canon_object")) for n, v in pairs])
    return p.select(F.col("p_partkey").alias("subject_id"), F.explode(each).alias("x")).select("subject_id", "x.*")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in which documents state their own end: two kinds that count, one with another date, one only inferred."""
    d = documents(spark, sf_dir).select("doc_id", "group_id", F.floor(F.col("doc_id") / 10000).alias("subject_id"), F.make_date((F.col("doc_id") % 10000 + 1).cast("int"), F.lit(6), F.lit(30)).alias("end"))
    kind = F.col("doc_id") % 4
    predicate = F.when(kind == 0, "有效期至").when(kind == 1, " 失效日期 ").when(kind == 2, "有效期限").otherwise("到期日期")
    said = F.when(kind == 2, F.date_add("end", 1)).otherwise(F.col("end"))
    object_type = F.when(kind == 1, "string").otherwise("date")
    null = F.lit(None)
    return d.select(
        F.concat(F.lit("statement-"), "doc_id").alias("fact_id"),
        F.col("subject_id").cast("long").alias("subject_id"),
        predicate.alias("predicate"),
        F.trim(predicate).alias("pred_fold"),
        object_type.alias("object_type"),
        null.cast("double").alias("object_number"),
        F.concat_ws("|", F.lit("scalar"), object_type, F.date_format(said, "yyyy-MM-dd")).alias("canon_object"),
        null.cast("string").alias("measure_unit"),
        "doc_id",
        null.cast("date").alias("valid_from"),
        F.col("end").alias("valid_to"),
        F.when(kind == 0, "quoted").when(kind == 3, "document_scope").alias("valid_to_anchor"),
        null.cast("date").alias("observed_at"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Proposals for every part: two quantity predicates are one, a third is misspelt; and no equal texts."""
    aliases = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("alias"), F.lit(s).alias("span")) for o, a, s in ((0, " QTY_A ", "qty"), (1, "qty_n", "not there"), (2, "Qty_Z", "qty"))])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject_id"), F.lit(0).alias("cluster"), F.lit("Quantity").alias("canonical_name"), F.lit("measure").alias("value_kind"), F.explode(aliases).alias("x"))
    texts = spark.createDataFrame([], "subject_id long, cluster int, value_kind string, a string, b string")
    return p.select("subject_id", "cluster", "canonical_name", "value_kind", "x.*"), texts
