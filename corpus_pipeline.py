"""Five stages from raw documents to token ids, each written as Parquet and read again by the next.

Documents that the quality classifier rejects go; one document of each group of near
copies stays; documents contaminated by benchmark passages go; secrets are masked in
the text; what is left is encoded, decoded again and compared.

Rows are judged by their own text: null texts are empty, rows that repeat an id are told
apart by their texts, and copies with one id and text are near copies of each other. Null
ids stay null. Very long texts are read whole. Documents may have further columns of any
name, which all stages but the last pass on; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, decontamination, jaccard_join, quality, secrets
from factloom.session import scratch_path, ship_package, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier predicts to be of label 1."""
    ship_package(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts linked by 5-word shingles."""
    ship_package(spark)
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which benchmark passages are less than a twentieth of the words."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets of each text, and counts its characters anew."""
    masked = secrets.redacted(docs)
    changed = masked.withColumn("n_chars", F.when(F.contains("text", F.lit(secrets.MASK)), F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return changed.select(docs.columns)


def byte_bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of what they decode to and of the text itself."""
    ship_package(spark)
    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe_tokens", byte_bpe_tokens),
]

#: Trained models decide in two stages, which SQL cannot express; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
