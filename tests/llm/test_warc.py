from __future__ import annotations

import base64
import glob
import hashlib
import io
import struct

import zstandard

from factloom.llm import catalog, oracles, warc
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, id int")


def brute_force(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data, f = (h or "").encode(), first.get(h or "")
        revisit = f is not None and i != f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


ROWS = [(5, "http://a/\r\nx: y", "same"), (3, None, "same"), (3, "u", "same"), (9, "u", "same"), (None, "u", "same"), (None, "u", "only null"), (1, "u", None), (2, "u", ""), (7, "ü", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", "x" * 300_000)]


def test_round_trip(spark, tmp_path):
    rows = ROWS + [(100 + k, f"http://h/{k}", f"<html><body>page {k} {'lorem ipsum ' * (k % 9)}</body></html>") for k in range(200)]
    folder = f"file://{tmp_path}/archive"
    manifest = warc.write_archives(frame(spark, rows).repartition(3), folder)
    got = warc.read_archives(manifest, payloads=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_force(rows)
    texts = {}
    for i, _, h in rows:
        texts.setdefault(i, set()).add(h or "")
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload).decode() in texts[r.page_id] for r in got)
    assert sum(r.records for r in manifest.collect()) == len(rows)


def test_files_follow_the_format(spark, tmp_path):
    """Leading skippable frame with the dictionary; every record is a frame of its own."""
    rows = [(k, "u", f"<p>{k} some words that recur</p>") for k in range(300)]
    warc.write_archives(frame(spark, rows).repartition(1), f"file://{tmp_path}")
    (name,) = glob.glob(f"{tmp_path}/*.warc.zst")
    data = open(name, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest, records = data[8 + size :], 0
    while rest:
        one = decoder.decompressobj()
        plain = one.decompress(rest)
        assert len(list(warc.parse(io.BufferedReader(io.BytesIO(plain))))) == 1
        rest, records = one.unused_data, records + 1
    assert records == 300
    assert len(data) < sum(len(zstandard.compress(warc.record(k, "u", h.encode(), None, False, "1970-01-01T00:00:00Z"))) for k, _, h in rows)


def test_files_roll_over(tmp_path):
    writer = warc.ArchiveWriter(f"file://{tmp_path}", "s", b"", file_bytes=50)
    for k in range(5):
        writer.add(warc.record(k, None, b"p", None, False, "d"))
    writer.close()
    assert len(writer.done) == 5 and [int(h["warc-record-id"][10:-1]) for f, _, _ in writer.done for h, _ in warc.read_archive(f)] == list(range(5))


def test_small_payloads_stay_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = warc.read_archives(warc.write_archives(frame(spark, rows), f"file://{tmp_path}", min_bytes=3)).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_table(spark, tmp_path):
    assert warc.read_archives(warc.write_archives(frame(spark, ROWS).limit(0), f"file://{tmp_path}")).count() == 0


def test_query_equals_sql(spark):
    assert assert_same(catalog.op3_warc(spark, SMALL), SMALL, oracles.OP3) == 250
