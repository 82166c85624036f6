from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import unicode
from factloom.session import ARROW_ROWS
from factloom.sources import files, sinks


def test_discovery_parsing_and_hashes(spark, tmp_path):
    (tmp_path / "a/deep").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "a/one.txt").write_bytes("﻿first line\nsecond\r\n\r\n  third  \n".encode())
    (tmp_path / "a/deep/two.md").write_bytes("价格 100".encode("gb18030"))
    (tmp_path / "a/t.CSV").write_text('name,,price\n"x, y",5,10\n,,\n"say ""hi""",,,extra\n')
    (tmp_path / "a/head.csv").write_text("only,header\n")
    (tmp_path / "a/skip.bin").write_text("no")
    (tmp_path / "b/draft.txt").write_text("ignored")
    found = files.discover(spark, str(tmp_path), [{"path": "a", "type": "pricing"}, {"path": "", "authority": 0.5}], ["**/draft*"])
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {"a/one.txt", "a/deep/two.md", "a/t.CSV", "a/head.csv"}
    assert rows["a/one.txt"].source_type == "pricing"
    blocks = {(r.path, r.ord): r.text for r in files.text_blocks(found).collect()}
    assert blocks == {("a/one.txt", 0): "first line\nsecond", ("a/one.txt", 1): "third", ("a/deep/two.md", 0): "价格 100"}
    cells = {(r.path, r.row): r.text for r in files.csv_blocks(found).collect()}
    assert cells == {("a/t.CSV", 2): "name: x, y; col_2: 5; price: 10", ("a/t.CSV", 3): 'name: say "hi"', ("a/head.csv", 1): "only | header"}
    assert {r.path: (r.paragraph, r.offset_start, r.offset_end) for r in files.text_blocks(found).where("ord = 1").collect()} == {"a/one.txt": (1, 19, 28)}
    warned = {(r.path, r.warning) for r in files.listed(spark, str(tmp_path), [{"path": "a"}, {"path": "none"}])[1].collect()}
    assert warned == {("none", "missing_source"), ("a/skip.bin", "unsupported_type")}
    known = found.limit(1).select("file_hash", F.lit("parsed").alias("status"))
    assert files.pending(found, known).count() == 3


def workbook(sheets: dict) -> bytes:
    """A small workbook: strings are shared, numbers and truth values plain, rows and columns may be left out."""
    strings: list[str] = []

    def cell(place: str, value) -> str:
        if isinstance(value, bool):
            return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{place}"><v>{value}</v></c>'
        strings.append(value)
        return f'<c r="{place}" t="s"><v>{len(strings) - 1}</v></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">' + "".join(cell(f"{chr(65 + c)}{n}", v) for c, v in r.items()) + "</row>" for n, r in rows.items())
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{name}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
    return out.getvalue()


def document(*parts) -> bytes:
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    par = lambda t: "<w:p>" + "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in t.split("|")) + "</w:p>"
    body = "".join(par(p) if isinstance(p, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{par(c)}</w:tc>" for c in r) + "</w:tr>" for r in p) + "</w:tbl>" for p in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_office_files(spark, tmp_path):
    sheets = {
        "prices": {1: {0: "Price list"}, 3: {0: "name", 1: "price", 3: "until"}, 4: {0: "Plan", 1: 5.0, 3: "May"}, 6: {1: 6.5, 2: "no header"}, 7: {0: "valid in Europe"}, 8: {1: True, 3: "x"}},
        "single": {2: {1: "owner"}, 3: {1: "Ann"}, 9: {1: "Bob"}},
        "header": {5: {0: "a", 2: "b"}},
        "one": {1: {0: "alone"}},
        "none": {},
    }
    (tmp_path / "t.xlsx").write_bytes(workbook(sheets))
    (tmp_path / "d.docx").write_bytes(document("He|llo", "  ", [["a", "", "b"], ["", ""]], "after"))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    found = files.discover(spark, str(tmp_path), [{"path": ""}])
    blocks, failures = files.blocks(found)
    got = [(r.path, r.sheet, r.row, r.paragraph, r.text) for r in blocks.orderBy("path", "ord").collect()]
    assert got == [
        ("d.docx", None, None, 0, "Hello"), ("d.docx", None, None, 1, "after"), ("d.docx", None, None, 2, "a | b"),
        ("t.xlsx", "prices", 1, None, "Price list"), ("t.xlsx", "prices", 4, None, "name: Plan; price: 5; until: May"), ("t.xlsx", "prices", 6, None, "price: 6.5"), ("t.xlsx", "prices", 7, None, "valid in Europe"), ("t.xlsx", "prices", 8, None, "price: True; until: x"),
        ("t.xlsx", "single", 3, None, "owner: Ann"), ("t.xlsx", "single", 9, None, "owner: Bob"), ("t.xlsx", "header", 5, None, "a | b"), ("t.xlsx", "one", 1, None, "alone"),
    ]
    assert [r.path for r in failures.collect()] == ["bad.docx"]


def test_csv_with_quotes_and_line_ends():
    assert files.csv_table('a,b\n"x\ny","he said ""no"""\nplain "quote",2,3\n') == [(2, 'a: x\ny; b: he said "no"'), (3, 'a: plain "quote"; b: 2')]
    assert files.csv_table("\n , \n") == []


def test_artifacts_and_json_lines(spark, tmp_path):
    x = spark.createDataFrame([(1, None), (2, "b")], "n long, t string")
    sinks.write_jsonl(x, str(tmp_path / "a"))
    assert {(r.n, r.t) for r in sinks.read_jsonl(spark, str(tmp_path / "a"), "n long, t string").collect()} == {(1, None), (2, "b")}
    (tmp_path / "b.jsonl").write_text('{"n": 1}\nno json\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        sinks.read_jsonl(spark, str(tmp_path / "b.jsonl"), "n long").collect()


def test_normal_forms(spark):
    x = spark.createDataFrame([("cafe\u0301",), ("ascii",), ("ｋｇ\u3000１",), (None,)], "t string")
    got = [tuple(r) for r in x.select(unicode.normalized(x.t, "NFC"), unicode.normalized(x.t, "NFKC"), unicode.narrowed(x.t)).collect()]
    assert got == [("café", "café", "cafe\u0301"), ("ascii",) * 3, ("ｋｇ\u3000１", "kg 1", "kg 1"), (None, None, None)]


def test_ignore_patterns(spark):
    paths = ["x/y/a.txt", "a.txt", "build/z/q.txt", "src/build/q.txt"]
    x = spark.createDataFrame([(p,) for p in paths], "p string")
    match = lambda *g: {r.p for r in x.where(files.is_ignored(F.col("p"), list(g))).collect()}
    assert match("*.txt") == set(paths)
    assert match("**/a.txt") == {"x/y/a.txt", "a.txt"}
    assert match("build/**") == {"build/z/q.txt"}
    assert match("**/build/**") == {"build/z/q.txt", "src/build/q.txt"}


def test_version_links(spark):
    docs = spark.createDataFrame([(1, "p/v1.txt"), (2, "p/v2.txt"), (3, "q/v2.txt"), (4, "q/only.txt")], "doc_id long, path string")
    mapping = spark.createDataFrame([("g", 0, "p/v1.txt", "1", None), ("g", 1, "only.txt", "2", "p/v1.txt"), ("g", 2, "v2.txt", "3", "gone.txt")], "group string, ord int, path string, label string, supersedes string")
    edges, warnings = files.version_links(docs, mapping)
    assert {(r.doc_id, r.prev_id) for r in edges.collect()} == {(1, None), (4, 1)}
    assert {(r.path, r.warning) for r in warnings.collect()} == {("v2.txt", "ambiguous"), ("gone.txt", "missing")}


def test_links_are_applied(spark):
    docs = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "doc_id string, path string")
    edges = spark.createDataFrame([("g", "old", "1", None), ("g", "new", "2", "1")], "group string, label string, doc_id string, prev_id string")
    got = {r.doc_id: r for r in files.apply_links(docs, edges).collect()}
    assert (got["1"].version_label, got["2"].version_label, got["2"].prev_id, got["3"].group_id) == ("old", "new", "1", None) and got["1"].group_id == got["2"].group_id


def dated_workbook(cells: list[tuple[float, int]], formats: list[tuple[int, str | None]], old_calendar: bool) -> bytes:
    """A workbook of one column: serial numbers with a style each; styles are number formats, own ones with a code."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f'<row r="{n}"><c r="A{n}" s="{style}"><v>{value!r}</v></c></row>' for n, (value, style) in enumerate(cells, 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="{int(old_calendar)}"/><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        own = "".join(f'<numFmt numFmtId="{k}" formatCode="{code.replace(chr(34), "&quot;")}"/>' for k, code in formats if code)
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts>{own}</numFmts><cellXfs>' + "".join(f'<xf numFmtId="{k}"/>' for k, _ in formats) + "</cellXfs></styleSheet>")
    return out.getvalue()


@pytest.mark.parametrize("old_calendar", [False, True])
def test_numbers_with_a_date_format_are_dates(old_calendar):
    formats = [(0, None), (14, None), (164, 'yyyy"年"m"月"d"日"'), (165, '0.00" days"'), (166, "[h]:mm:ss"), (167, "[Red]#,##0.00_d"), (168, "[$-804]yyyy-mm-dd;@"), (20, None), (46, None), (31, None)]
    cells = [(45292.0, 0), (45292.0, 1), (45292.5, 2), (3.0, 3), (1.25, 4), (1234.5, 5), (45292.0, 6), (0.75, 7), (0.5, 8), (45292.0, 9), (59.0, 1), (1e12, 1)]
    got = [r[0] for _, r in files.xlsx_sheets(dated_workbook(cells, formats, old_calendar))[0][1]]
    day = "2028-01-02" if old_calendar else "2024-01-01"
    low = "1904-02-29 00:00:00" if old_calendar else "1900-02-28 00:00:00"
    assert got == ["45292", f"{day} 00:00:00", f"{day} 12:00:00", "3", "1 day, 6:00:00", "1234.5", f"{day} 00:00:00", "18:00:00", "12:00:00", "45292", low, "1000000000000"]


def test_normal_forms_get_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        unicode.normalized(F.lit("x"))
        assert spark.conf.get(name) == str(ARROW_ROWS)
    finally:
        spark.conf.set(name, before)
