import io
import zipfile

from pyspark.sql import functions as F

from kbweave.operators.answers import filter_log, level_rank, parse_footer
from kbweave.plans.registry.sources import _package, _rels, make_docx, make_pptx
from kbweave.sources.files import extract_files, quarantine, read_texts, scan_files, usable
from kbweave.sources.office import S, W, _java_double, docx_text, extract_one, xlsx_text
from kbweave.sources.streams import parse_log_lines, parse_sse, read_logs


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(make_docx(["one", "two & three"]))
    (tmp_path / "sub" / "b.pptx").write_bytes(make_pptx(["run 1", " ", "run 2"]))
    (tmp_path / "c.html").write_text("<p>tag\n stays</p>", encoding="utf-8")
    (tmp_path / "d.xlsx").write_bytes(b"broken")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.doc").write_bytes(b"old")
    (tmp_path / "g.txt").write_bytes(b"ok \xff bytes")
    (tmp_path / "empty.txt").write_bytes(b"")
    extracted = extract_files(scan_files(spark, str(tmp_path)))
    texts = {r["file_name"]: r["text"] for r in usable(extracted).collect()}
    assert texts == {
        "a.docx": "one two & three", "b.pptx": "幻灯片 1: run 1 run 2", "c.html": "<p>tag stays</p>", "g.txt": "ok � bytes",
    }
    assert sorted(r["file_name"] for r in quarantine(extracted).collect()) == ["d.xlsx", "e.pdf", "f.doc"]
    assert read_texts(spark, str(tmp_path / "c.html")).first()["text"] == "<p>tag\n stays</p>"
    assert scan_files(spark, str(tmp_path), "*.pptx").count() == 1


def test_spreadsheet():
    sheet = lambda rows: f'<worksheet xmlns="{S[1:-1]}"><sheetData>{rows}</sheetData></worksheet>'
    data = _package(
        {
            "xl/workbook.xml": f'<workbook xmlns="{S[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            '<sheets><sheet name="B" r:id="r1"/><sheet name="A" r:id="r0"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _rels("/xl/worksheets/s1.xml", "worksheets/s2.xml"),
            "xl/sharedStrings.xml": f'<sst xmlns="{S[1:-1]}"><si><r><t>sha</t></r><r><t>red</t></r></si></sst>',
            "xl/worksheets/s1.xml": sheet('<row><c t="s"><v>0</v></c><c><v>12</v></c></row><row><c/></row>'),
            "xl/worksheets/s2.xml": sheet(
                '<row><c t="b"><v>0</v></c><c t="str"><f>X</f><v>calc</v></c><c><f>1+1</f><v>2.5</v></c></row>'
            ),
        }
    )
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        assert xlsx_text(archive) == '工作表: B\nfalse\t"calc"\t2.5\t\n\n工作表: A\nshared\t12.0\t\n\n'


def test_document_tables():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t><w:tab/><w:t>z</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    data = _package({"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{p("x")}{table}</w:body></w:document>'})
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        assert docx_text(archive) == "x\tz\na\tz\tb\tz\n"
    assert "BadZipFile" in extract_one("x.docx", b"no")["error"]


def test_java_numbers():
    cases = {0.0: "0.0", 5.0: "5.0", 1e7: "1.0E7", 1234567.5: "1234567.5", 1.5e10: "1.5E10", 0.001: "0.001", 2.5e-4: "2.5E-4", -1e21: "-1.0E21"}
    assert {v: _java_double(v) for v in cases} == cases


def test_logs(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_text("2024-05-06 07:08:09.123 E/Tag: bad: thing\n\tat x\n2024-05-06 07:08:10.000 D/Other: fine\n")
    logs = parse_log_lines(spark.read.text(str(path)))
    rows = logs.collect()
    assert [(r["level"], r["tag"], r["message"]) for r in rows] == [
        ("E", "Tag", "bad: thing"), (None, None, "\tat x"), ("D", "Other", "fine"),
    ]
    assert rows[0]["ts"].microsecond == 123000
    assert filter_log(logs, min_level="WARNING").count() == 1 and filter_log(logs, end="2024-05-06 07:08:10").count() == 1
    names = spark.createDataFrame([("verbose",), ("W",), ("x",)], "l string")
    assert [r[0] for r in names.select(level_rank(F.col("l"))).collect()] == [0, 3, None]


def test_entries_keep_their_lines_across_splits(spark, tmp_path):
    entries = []
    for i in range(200):
        trace = "".join(f"\n\tat line {j} of {i}" for j in range(i % 7 * 5))
        entries.append((f"2024-05-06 07:08:09.{i:03d} E/Tag: entry {i}" + trace, f"entry {i}" + trace))
    (tmp_path / "a.log").write_text("early line\n" + "\n".join(e for e, _ in entries) + "\n")
    (tmp_path / "b.log").write_text(entries[1][0] + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    messages = sorted(r["message"] for r in rows)
    assert messages == sorted([m for _, m in entries] + ["early line", entries[1][1]])
    assert sum(r["level"] == "E" for r in rows) == 201


def test_sse(spark):
    lines = [
        'data: {"choices":[{"delta":{"content":"a"}}]}', "data: [DONE]", "", "data: {bad", 'data: {"choices":[]}',
        'data: {"choices":[{"delta":{"role":"x"}}]}', 'data: {"choices":[{"delta":{"content":""}}]}', ': ping',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "seq int, value string")
    assert [(r["seq"], r["content"]) for r in parse_sse(df).collect()] == [(0, "a"), (6, "")]


def test_footer(spark):
    text = "hi\n\n---\ntokens: 12 • Time: 3.50s • Rate: 3.43 token/s • JVMMaxMem: 1MB"
    df = spark.createDataFrame([(text,), ("none",)], "a string").select(parse_footer(F.col("a")).alias("f"))
    a, b = [r["f"].asDict() for r in df.collect()]
    assert a == {"tokens": 12, "seconds": 3.5, "rate": 3.43} and set(b.values()) == {None}
