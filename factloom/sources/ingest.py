"""Ingestion of a workspace: files to documents and chunks, once for each content, with versions as declared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import Settings
from factloom.functions.text import chunks_of, content_hash
from factloom.session import stored
from factloom.sources import files as S

DOCUMENT = "doc_id string, path string, filename string, file_hash string, content_hash string, status string, error string, source_type string, authority double, group_id string, version_label string, prev_id string, parsed_at timestamp"
FILE = "path string, size bigint, modified timestamp, file_hash string"


@dataclass
class Ingested:
    """All documents, the chunks of those parsed now, the listing of ``files (path, size, modified, file_hash)``, warnings ``(path, warning)``, and how many files were new, unchanged or failed."""

    documents: DataFrame
    chunks: DataFrame
    files: DataFrame
    warnings: DataFrame
    counts: dict[str, int]


def run(spark: SparkSession, base: str, settings: Settings, known: DataFrame | None = None, seen: DataFrame | None = None) -> Ingested:
    """Files of the sources that are not known yet, parsed, hashed and cut into chunks.

    ``seen`` is the listing of an earlier run: files that it had with the same size and time
    are not read again.

    Known documents keep what was recorded of them; failed ones are tried again. A file that
    cannot be parsed is a document with status failed and its error.
    """
    listing, warnings = S.listed(spark, base, settings.sources, settings.ignore)
    listing = stored(listing, "listing")
    known = spark.createDataFrame([], DOCUMENT) if known is None else known
    same = S.unchanged(listing, seen, known) if seen is not None else spark.createDataFrame([], FILE)
    same = stored(same, "unchanged-files")
    found = stored(S.with_content(spark, listing.join(same.select("path"), "path", "left_anti")), "files")
    everything = stored(same.unionByName(found.select("path", "size", "modified", "file_hash")), "file-listing")
    todo = stored(S.pending(found, known), "pending-files")
    blocks, failures = S.blocks(todo)
    blocks = stored(blocks, "blocks")
    whole = F.struct(*[F.col(c) for c in sorted(["text", "page", "paragraph", "row", "sheet", "offset_start", "offset_end"])])
    per = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", whole.alias("b")))).alias("o")).select("path", F.transform("o", lambda x: x["b"]).alias("blocks"))  # one file
    x = todo.drop("content", "extension", "size", "modified").join(per, "path", "left").join(failures, "path", "left")
    x = x.withColumn("doc_id", F.col("file_hash")).withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("status", F.when(F.col("error").isNull(), "parsed").otherwise("failed"))
    empty = F.from_json(F.lit("[]"), blocks.select(F.array(whole).alias("a")).schema["a"].dataType.simpleString())
    x = stored(x.withColumn("blocks", F.coalesce("blocks", empty)), "parsed-files")
    null = F.lit(None).cast("string")
    fresh = x.select("doc_id", "path", "filename", "file_hash", F.when(F.col("status") == "parsed", content_hash(F.col("blocks"))).alias("content_hash"), "status", "error", "source_type", "authority", null.alias("group_id"), null.alias("version_label"), null.alias("prev_id"), F.current_timestamp().alias("parsed_at"))
    old = known.join(fresh.select("doc_id"), "doc_id", "left_anti")
    documents = old.unionByName(fresh)
    mapping = [(g["group"], k, f["path"], f.get("label"), f.get("supersedes")) for g in settings.versions for k, f in enumerate(g["files"])]
    if mapping:
        edges, told = S.version_links(documents.where("status = 'parsed'"), spark.createDataFrame(mapping, "group string, ord int, path string, label string, supersedes string"))
        documents, warnings = S.apply_links(documents, edges), warnings.unionByName(told)
    documents = stored(documents.select(*[c.split()[0] for c in DOCUMENT.split(", ")]), "documents")
    units = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["page"].alias("page")))
    chunks = x.where("status = 'parsed'").select("doc_id", F.explode(chunks_of(units)).alias("c")).select(F.concat_ws("-", "doc_id", "c.chunk_index").alias("chunk_id"), "doc_id", "c.*")
    n, failed = todo.count(), x.where("status = 'failed'").count()
    total = listing.count()
    return Ingested(documents, chunks, everything, warnings, {"files": total, "new": n - failed, "failed": failed, "unchanged": total - n})
