"""The opN queries: thin digests of the operators of this subpackage over their whole tables."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, decontamination, imatch, jaccard_join, merkle, oracles, passages, quality, secrets, suffix_tree, token_counts, url_filter, warc, whitening
from factloom.session import ship_package, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 512 tokens."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the bytes that they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, and whether its label could have been learned."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it was read back from the archives: payload, digest, response or revisit."""
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret with its place, a digest of it, and how the forest judges it."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("secret", 256).alias("secret_sha256"), "probability", "is_secret")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles of every document, and the smallest id that links lead to."""
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark phrases, the items, and whether it is contaminated."""
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document are."""
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share passages of 50 words or more with others, and where."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


URL_RULES = [
    url_filter.Rule("org/", "allow"),
    url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by single tokens and by the suffix tree, and whether it was held out."""
    return suffix_tree.fit_and_score(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 leading components, with its exact deviation and the shares that components explain."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and lookup proof of every document, and whether it verifies as it is checked."""
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def _shipped(query):
    """The query, after this package has been sent to the executors."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {q.__name__: _shipped(q) for q in (op1_token_counts, op2_quality, op3_warc, op4_secrets, op5_jaccard_join, op6_decontamination, op7_byte_bpe, op8_imatch, op9_compact_windows, op10_url_filter, op11_lm_scoring, op12_whitening, op13_merkle)}
ORACLES = {"op3_warc": oracles.OP3, "op5_jaccard_join": oracles.OP5, "op6_decontamination": oracles.OP6, "op13_merkle": oracles.OP13}
