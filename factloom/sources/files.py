"""File sources: discovery, ignore patterns, decoding, and parsers of text, CSV, XLSX and DOCX into blocks.

A block is ``(path, ord, text, page, paragraph, row, sheet, offset_start, offset_end)``; what a
format does not have is null. Files that cannot be read give a failure instead of blocks.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import paragraph_spans
from factloom.functions.unicode import normalized
from factloom.session import ship_package, stored

TEXT_TYPES = ("txt", "md", "markdown")
TABLE_TYPES = ("csv",)
OFFICE_TYPES = ("xlsx", "docx")
SUPPORTED = (*TEXT_TYPES, *TABLE_TYPES, *OFFICE_TYPES)
BLOCK = "ord int, text string, page int, paragraph int, row int, sheet string, offset_start int, offset_end int"
_FIELDS = [c.split()[0] for c in BLOCK.split(", ")]


def glob_pattern(pattern: str) -> str:
    """A regular expression for a glob: ``*`` and ``?`` cross folders, a leading ``**/`` is optional."""
    head = ""
    if pattern.startswith("**/"):
        head, pattern = "(?:.*/)?", pattern[3:]
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{head}{out}$"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path, or for folder patterns one of its folders, matches a pattern."""
    hit = F.lit(False)
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    for pattern in patterns:
        hit = hit | path.rlike(glob_pattern(pattern))
        if pattern.endswith("/**") or pattern.endswith("/"):
            folder = glob_pattern(pattern.rstrip("*").rstrip("/"))
            hit = hit | F.exists(folders, lambda f: f.rlike(folder))  # noqa: B023  used at once
    return hit


def listed(spark: SparkSession, base: str, sources: list[dict], ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All files under the sources ``(path, source_type, authority, extension, url, size, modified)``, and warnings ``(path, warning)``: sources that are not there, types that no parser takes.

    The first source that holds a path wins. Ignored files are in neither. Nothing is read
    of the files: the listing knows their sizes and times.
    """
    if not sources:
        raise ValueError("at least one source is needed")
    jvm, missing, found = spark.sparkContext._jvm, [], None
    for ord_, source in enumerate(sources):
        where = f"{base.rstrip('/')}/{source['path'].strip('/')}"
        path = jvm.org.apache.hadoop.fs.Path(where)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            missing.append((source["path"], "missing_source"))
            continue
        x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
        x = x.select("path", F.col("path").alias("url"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(ord_).alias("ord"), F.lit(source.get("type", "document")).alias("source_type"), F.lit(float(source.get("authority", 0.9))).alias("authority"))
        found = x if found is None else found.unionAll(x)
    warnings = spark.createDataFrame(missing, "path string, warning string")
    if found is None:
        return spark.createDataFrame([], LISTED), warnings
    root = re.escape(base.rstrip("/").split("://")[-1])
    x = found.withColumn("path", F.regexp_replace("path", f"^[a-z]+:/*{root}/|^{root}/", "")).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    x = x.where(~is_ignored(F.col("path"), ignore or []))
    first = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    x = x.withColumn("n", first).where("n = 1")
    known = F.col("extension").isin(*SUPPORTED)
    warnings = warnings.unionAll(x.where(~known).select("path", F.lit("unsupported_type")))
    return x.where(known).select(*[c.split()[0] for c in LISTED.split(", ")]), warnings


LISTED = "path string, source_type string, authority double, extension string, url string, size bigint, modified timestamp"


def with_content(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """Files of a listing with ``content`` and ``file_hash``; only these files are read.

    Their paths pass through the driver, as all paths do that Spark reads.
    """
    listing = stored(listing, "files-to-read")
    urls = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.url) for r in listing.select("url").collect()]
    if not urls:
        return listing.withColumns({"content": F.lit(None).cast("binary"), "file_hash": F.lit(None).cast("string")}).drop("url")
    read = spark.read.format("binaryFile").load(urls).select(F.col("path").alias("url"), "content", F.sha2("content", 256).alias("file_hash"))
    return listing.join(read, "url").drop("url")


def unchanged(listing: DataFrame, seen: DataFrame, known: DataFrame) -> DataFrame:
    """``(path, size, modified, file_hash)`` of the files that an earlier listing ``seen`` had with the same size and time, and whose content is parsed."""
    parsed_ = known.where("status = 'parsed'").select("file_hash").distinct()
    same = listing.select("path", "size", "modified").join(seen.select("path", "size", "modified", "file_hash"), ["path", "size", "modified"])
    return same.join(parsed_, "file_hash", "left_semi").select("path", "size", "modified", "file_hash")


def discover(spark: SparkSession, base: str, sources: list[dict], ignore: list[str] | None = None) -> DataFrame:
    """``(path, source_type, authority, extension, content, file_hash)`` of supported files under the sources; see :func:`listed` for the others."""
    return with_content(spark, listed(spark, base, sources, ignore)[0]).select("path", "source_type", "authority", "extension", "content", "file_hash")


def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda data: decode_bytes(bytes(data)), na_action="ignore")


def decode_bytes(data: bytes) -> str:
    """Bytes as text: UTF-8, else GB18030, else Latin-1."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def decode(content: Column) -> Column:
    """:func:`decode_bytes` of a column. Valid UTF-8 stays inside the JVM."""
    plain = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    return F.when(F.is_valid_utf8(content.cast("string")), plain).otherwise(F.pandas_udf(_decoded, "string")(F.when(~F.is_valid_utf8(content.cast("string")), content)))


def _whole(frame: DataFrame, **given: Column) -> DataFrame:
    """A frame with ``path`` and some block fields, with all of them."""
    types = dict(c.split() for c in BLOCK.split(", "))
    return frame.select("path", *[given.get(f, F.col(f) if f in frame.columns else F.lit(None)).cast(types[f]).alias(f) for f in _FIELDS])


def text_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs of text files, in NFC, with their places in the decoded text."""
    ship_package(files.sparkSession)
    x = files.where(F.col("extension").isin(*TEXT_TYPES)).select("path", F.regexp_replace(decode(F.col("content")), "\r\n?", "\n").alias("t"))
    x = x.select("path", F.posexplode(paragraph_spans(F.col("t"))).alias("ord", "b")).select("path", "ord", normalized(F.col("b.text")).alias("text"), F.col("ord").alias("paragraph"), "b.offset_start", "b.offset_end")
    return _whole(x)


def csv_table(text: str) -> list[tuple[int, str]]:
    """``(row, text)``: ``header: value`` pairs of each non-blank record; a header alone is its cells joined."""
    records = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""))]
    records = [r for r in records if any(r)]
    if not records:
        return []
    header = [c or f"col_{i}" for i, c in enumerate(records[0], 1)]
    if len(records) == 1:
        return [(1, " | ".join(header))]
    out = [(n, "; ".join(f"{h}: {c}" for h, c in zip(header, r) if c)) for n, r in enumerate(records[1:], 2)]
    return [(n, t) for n, t in out if t]


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


#: Built-in number formats that show a date or a time, and those that show a duration; what such a format is made of. Fixed values.
DATE_FORMATS, DURATION_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 47), (46,)
_NO_LETTERS = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]', re.I)
_DURATION = re.compile(r"\[(hh?|mm?|ss?)\]", re.I)
#: Day 0 of the two calendars; the older one has a 29 February 1900 that never was.
EPOCH_1900, EPOCH_1904, LEAP_1900 = datetime(1899, 12, 30), datetime(1904, 1, 1), 60


def number_kinds(styles: bytes | None) -> list[str | None]:
    """What the number format of each cell style shows: ``date``, ``duration``, or None for a number."""
    if styles is None:
        return []
    root = ElementTree.fromstring(styles)
    codes = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}

    def kind(number: int) -> str | None:
        if number not in codes:
            return "date" if number in DATE_FORMATS else "duration" if number in DURATION_FORMATS else None
        code = _NO_LETTERS.sub("", codes[number].split(";")[0])
        if _DURATION.search(code):
            return "duration"
        return "date" if re.search("[dmhys]", code, re.I) else None

    cells = root.find(f"{_MAIN}cellXfs")
    return [kind(int(xf.get("numFmtId") or 0)) for xf in cells] if cells is not None else []


def serial_text(value: float, kind: str, epoch: datetime) -> str | None:
    """A serial number as the date and time, the time or the duration that it stands for; None beyond the calendar."""
    day, part = divmod(value, 1)
    rest = timedelta(milliseconds=round(part * 86_400_000))
    try:
        if kind == "duration":
            return str(timedelta(days=day) + rest)
        if 0 <= value < 1 and rest.days == 0:
            return str((datetime.min + rest).time())
        if 0 < value < LEAP_1900 and epoch == EPOCH_1900:
            day += 1
        return str(epoch + timedelta(days=day) + rest)
    except OverflowError:
        return None


def _cell(value: str | None, kind: str | None, shared: list[str], shows: str | None = None, epoch: datetime = EPOCH_1900) -> str:
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)].strip()
    if kind == "b":
        return "True" if value.strip() == "1" else "False"
    if kind in ("str", "inlineStr", "e", "d"):
        return value.strip()
    number = float(value)
    if shows and (shown := serial_text(number, shows, epoch)) is not None:
        return shown
    return str(int(number)) if number.is_integer() else repr(number)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = 26 * n + ord(c.upper()) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[tuple[int, list[str]]]]]:
    """``(name, [(row number, cells by column)])`` of the sheets of a workbook; numbers without needless decimals."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
        shared = [text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        kinds = number_kinds(book.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        whole = ElementTree.fromstring(book.read("xl/workbook.xml"))
        settings = whole.find(f"{_MAIN}workbookPr")
        epoch = EPOCH_1904 if settings is not None and settings.get("date1904") in ("1", "true") else EPOCH_1900
        out = []
        for sheet in whole.iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            rows, number = [], 0
            for row in ElementTree.fromstring(book.read(part)).iter(f"{_MAIN}row"):
                number = int(row.get("r") or number + 1)
                cells: dict[int, str] = {}
                for at, c in enumerate(row.iter(f"{_MAIN}c")):
                    inline, value = c.find(f"{_MAIN}is"), c.find(f"{_MAIN}v")
                    place = _column(c.get("r")) if c.get("r") else at
                    style = int(c.get("s") or 0)
                    shows = kinds[style] if style < len(kinds) else None
                    cells[place] = text(inline).strip() if inline is not None else _cell(value.text if value is not None else None, c.get("t"), shared, shows, epoch)
                rows.append((number, [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]))
            out.append((sheet.get("name"), rows))
        return out


def sheet_table(rows: list[tuple[int, list[str]]]) -> list[tuple[int, str]]:
    """``(row number, text)`` of a sheet: the first row with two cells is the header, what stands before it and single cells are notes.

    A sheet of one column has its first cell as the name of the others.
    """
    rows = [(n, r) for n, r in rows if any(r)]
    filled = lambda r: sum(1 for c in r if c)
    joined = lambda r: " ".join(c for c in r if c)
    at = next((i for i, (_, r) in enumerate(rows) if filled(r) >= 2), None)
    if at is None:
        if len(rows) < 2:
            return [(n, joined(r)) for n, r in rows]
        return [(n, f"{joined(rows[0][1])}: {joined(r)}") for n, r in rows[1:]]
    out = [(n, joined(r)) for n, r in rows[:at]]
    number, header = rows[at]
    if at + 1 == len(rows):
        return [*out, (number, " | ".join(c for c in header if c))]
    for n, r in rows[at + 1 :]:
        if filled(r) < 2:
            out.append((n, joined(r)))
        elif pairs := [f"{h}: {c}" for h, c in zip(header, r) if h and c]:
            out.append((n, "; ".join(pairs)))
    return out


def docx_paragraphs(data: bytes) -> list[str]:
    """The paragraphs of a document in order, then the rows of its tables with their cells joined; blank ones left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_WORD}body")

    def text(node) -> str:
        out = []
        for x in node.iter():
            if x.tag == f"{_WORD}t":
                out.append(x.text or "")
            elif x.tag == f"{_WORD}tab":
                out.append("\t")
            elif x.tag in (f"{_WORD}br", f"{_WORD}cr"):
                out.append("\n")
        return "".join(out).strip()

    found = [text(p) for p in body.findall(f"{_WORD}p")]
    for table in body.findall(f"{_WORD}tbl"):
        for row in table.findall(f"{_WORD}tr"):
            cells = ["\n".join(text(p) for p in c.findall(f"{_WORD}p")).strip() for c in row.findall(f"{_WORD}tc")]
            found.append(" | ".join(c for c in cells if c))
    return [f for f in found if f]


def parsed(extension: str, data: bytes) -> list[dict]:
    """The blocks of one file that Python reads: tables and office formats."""
    if extension == "csv":
        return [{"text": t, "row": n} for n, t in csv_table(decode_bytes(data))]
    if extension == "xlsx":
        return [{"text": t, "row": n, "sheet": name} for name, rows in xlsx_sheets(data) for n, t in sheet_table(rows)]
    if extension == "docx":
        return [{"text": t, "paragraph": i} for i, t in enumerate(docx_paragraphs(data))]
    raise ValueError(f"no parser takes {extension} files")


_PARSED = pa.schema([("path", pa.string()), *[(c.split()[0], pa.string() if c.endswith("string") else pa.int32()) for c in BLOCK.split(", ")], ("error", pa.string())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, extension, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                rows = [{"path": path, "ord": i, **b} for i, b in enumerate(parsed(extension, content))]
            except Exception as error:  # one broken file must not end the read
                rows = [{"path": path, "error": f"{type(error).__name__}: {error}"[:500]}]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _PARSED)


def table_blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of CSV, XLSX and DOCX files, and failures ``(path, error)``."""
    ship_package(files.sparkSession)
    x = files.where(F.col("extension").isin(*TABLE_TYPES, *OFFICE_TYPES)).select("path", "extension", "content").mapInArrow(_parse, f"path string, {BLOCK}, error string")
    good = x.where("error is null").drop("error")
    return good.withColumn("text", normalized(F.col("text"))), x.where("error is not null").select("path", "error")


def csv_blocks(files: DataFrame) -> DataFrame:
    """``(path, row, text)`` of CSV files; quoted cells may hold commas, doubled quotes and line ends."""
    return table_blocks(files.where(F.col("extension").isin(*TABLE_TYPES)))[0].select("path", "row", "text")


def blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of all supported files, and failures ``(path, error)``."""
    tables, failures = table_blocks(files)
    return text_blocks(files).unionByName(tables), failures


def version_links(docs: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and warnings from an explicit mapping ``(group, ord, path, label, supersedes)``.

    A path is matched exactly, else by its base name if only one document has it. What is
    ambiguous or missing gives a warning, never an edge.
    """
    base = F.element_at(F.split("path", "/"), -1)
    exact = docs.select("path", F.col("doc_id").alias("exact_id"))
    named = docs.groupBy(base.alias("base")).agg(F.min("doc_id").alias("base_id"), F.count("*").alias("n"))

    def located(col: str, out: str) -> DataFrame:
        wanted = mapping.select(F.col(col).alias("path")).where("path is not null").distinct()
        x = wanted.join(exact, "path", "left").withColumn("base", base).join(named, "base", "left")
        return x.select(F.col("path").alias(col), F.coalesce("exact_id", F.when(F.col("n") == 1, F.col("base_id"))).alias(out), F.when(F.col("exact_id").isNull() & (F.col("n") > 1), "ambiguous").when(F.col("exact_id").isNull() & F.col("n").isNull(), "missing").alias(f"{out}_warning"))

    x = mapping.join(located("path", "doc_id"), "path", "left").join(located("supersedes", "prev_id"), "supersedes", "left")
    edges = x.where("doc_id is not null").select("group", "label", "doc_id", "prev_id")
    warnings = x.select("path", F.col("doc_id_warning").alias("warning")).unionAll(x.select("supersedes", "prev_id_warning")).where("warning is not null")
    return edges, warnings


def apply_links(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """``docs`` with ``group_id, version_label, prev_id`` of their edges; others keep what they have. A document that several edges name takes the first by group."""
    one = edges.groupBy("doc_id").agg(F.min_by(F.struct("group", "label", "prev_id"), F.struct("group", "prev_id")).alias("e"))
    lacks = {c: F.lit(None).cast("string") for c in ("group_id", "version_label", "prev_id") if c not in docs.columns}
    x = docs.withColumns(lacks) if lacks else docs
    x = x.join(one, "doc_id", "left")
    group = F.sha2(F.concat(F.lit("group|"), F.col("e.group")), 256)
    return x.withColumns({"group_id": F.coalesce(group, F.col("group_id")), "version_label": F.coalesce(F.col("e.label"), F.col("version_label")), "prev_id": F.coalesce(F.col("e.prev_id"), F.col("prev_id"))}).drop("e")


def pending(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files to ingest: content that is unknown, or whose last attempt failed. One row for each content."""
    parsed_ = known.where("status = 'parsed'").select("file_hash").distinct()
    return files.join(parsed_, "file_hash", "left_anti").dropDuplicates(["file_hash"])
