"""WARC archives with dictionary-compressed records: a distributed writer and reader.

A Zstandard dictionary is built from a bounded sample of the records to be archived.
Every archive file begins with that dictionary in a skippable frame (magic number
0x184D2A5D), followed by one Zstandard frame for each record, so that a reader needs
nothing else and may start at any record.

Records with equal payloads are archived once: the smallest page id is the response,
the others are revisits that name it. Payloads below ``min_bytes`` are always
responses. Each task writes files under names of its own and reports them in a
manifest; files of lost or repeated attempts are in no manifest and never read.

Nulls are empty payloads, and empty payloads are equal to each other. Payloads are told
apart by SHA-256 and size. Very long payloads are whole records, held in memory one at a
time. Repeated rows with the smallest page id of a payload are all responses. A row with
a null id is a revisit if another id holds the payload, else a response. Further columns
are not read. Empty tables give no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import scratch_path, stored

MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: The dictionary is built from about this many records, twice as many at most, and from this much of each.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 8 << 10
#: A file is closed once it has this many bytes.
FILE_BYTES = 64 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record with an HTTP response; a revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed archive."""
    while first := stream.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
            raise ValueError("a record is cut short")
        yield headers, block


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; from samples too few or too alike for training, their own content."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class ArchiveWriter:
    """Writes records to files of bounded size in a folder; one for each task."""

    def __init__(self, folder: str, stem: str, dictionary: bytes, file_bytes: int = FILE_BYTES) -> None:
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.folder, self.stem, self.dictionary, self.file_bytes = folder, stem, dictionary, file_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.out, self.done, self.records = None, [], 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.stem}-{len(self.done):05d}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.out.write(dictionary_frame(self.dictionary))
        self.out.write(self.compressor.compress(data))
        self.records += 1
        if self.out.tell() >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.records, size))
            self.out, self.records = None, 0


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive file, decompressed with the dictionary it carries."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != MAGIC:
            raise ValueError(f"{uri} has no dictionary frame")
        dictionary = source.read(size)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        with decompressor.stream_reader(source, read_across_frames=True) as plain:
            yield from parse(io.BufferedReader(plain, 1 << 18))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (``id, url, payload``) with ``revisit`` and ``refers_to``.

    Only payloads that occur more than once are joined back; Spark broadcasts them
    when their stored size is below its threshold and shuffles the pages otherwise.
    """
    x = pages.withColumn("sha", F.sha2(F.encode("payload", "UTF-8"), 256)).withColumn("size", F.octet_length("payload"))
    groups = x.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    shared = stored(groups.where("c > 1 and first is not null").select("sha", "size", "first"), "shared-payloads")
    x = x.join(shared, ["sha", "size"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    return x.select("id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive every row of ``pages`` in ``folder``; returns the manifest ``(file, records, bytes)``, already stored."""
    x = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    # about SAMPLE_RECORDS rows by a hash of the id, so that no task sends more than its share; a hot id is cut by the limit
    parts = 1_000_000_000
    chosen = F.pmod(F.xxhash64("id"), F.lit(parts)) < F.lit(min(parts, parts * SAMPLE_RECORDS // max(x.count(), 1)))
    sample = x.where(chosen).select(F.substring("payload", 1, SAMPLE_BYTES).alias("payload"), "id", "url").limit(2 * SAMPLE_RECORDS).collect()
    dictionary = build_dictionary([record(r.id, r.url, r.payload.encode(), None, False, date) for r in sample])
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer = ArchiveWriter(folder, f"part-{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}", shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, revisit, refers_to = (batch.column(k)[i].as_py() for k in range(5))
                writer.add(record(page_id, url, payload.encode(), refers_to, revisit, date))
        writer.close()
        names, counts, sizes = zip(*writer.done, strict=True) if writer.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    return stored(with_revisits(x, min_bytes).mapInArrow(run, "file string, records bigint, bytes bigint"), "manifest")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "None") else None


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every archived record.

    Digests of responses are computed from the payloads read back and must equal
    those archived. ``payloads`` adds the payload; a revisit has none of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows: list[tuple] = []
                weight = 0
                for headers, block in read_archive(uri):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    revisit = headers["warc-type"] == "revisit"
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", head).group(1))
                    if not revisit and (digest_of(payload) != digest or len(payload) != size):
                        raise ValueError(f"{headers['warc-record-id']} in {uri} does not match its digest")
                    rows.append((_page(headers["warc-record-id"]), size, digest, headers["warc-type"], _page(headers.get("warc-refers-to")), *([None if revisit else payload] if payloads else [])))
                    weight += len(payload) if payloads else 1
                    if len(rows) >= 4096 or weight > 8 << 20:
                        yield _rows(rows, payloads)
                        rows, weight = [], 0
                yield _rows(rows, payloads)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    files = max(1, manifest.count())
    return manifest.select("file").repartition(min(files, 20_000)).mapInArrow(run, schema)


def _rows(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * payloads]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` (by default in the shared scratch folder) and read them back."""
    return read_archives(write_archives(pages, folder or scratch_path(spark, "warc")))
