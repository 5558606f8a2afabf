"""Text of zip-based office files, as a small parser inside an Arrow UDF."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column

from kbweave.functions.udfs import once

# Labels in the extracted text and XML namespaces.
SHEET_LABEL = "工作表: "
SLIDE_LABEL = "幻灯片 "
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

EXTRACT_SCHEMA = "struct<text:string,error:string>"


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship id to part name."""
    folder, name = posixpath.split(part)
    rels = _xml(archive, f"{folder}/_rels/{name}.rels")
    return {
        r.get("Id"): posixpath.normpath(posixpath.join("/" + folder, r.get("Target"))).lstrip("/")
        for r in rels.iter(f"{REL}Relationship")
    }


def _paragraph(node: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join(
        (n.text or "") if n.tag == f"{W}t" else marks.get(n.tag, "") for n in node.iter()
    )


def docx_text(archive: zipfile.ZipFile) -> str:
    """Paragraphs one per line; a table row is one line with its cells tab-separated."""
    lines = []
    for block in _xml(archive, "word/document.xml").find(f"{W}body"):
        if block.tag == f"{W}p":
            lines.append(_paragraph(block))
        elif block.tag == f"{W}tbl":
            for row in block.iter(f"{W}tr"):
                cells = ("\n".join(_paragraph(p) for p in c.iter(f"{W}p")) for c in row.findall(f"{W}tc"))
                lines.append("\t".join(cells))
    return "".join(line + "\n" for line in lines)


def _java_double(value: float) -> str:
    """A number the way Java prints a double."""
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return repr(value)
    digits, exponent = f"{value:.16e}".split("e")
    shortest = repr(float(value))
    if "e" in shortest:
        digits = shortest.split("e")[0]
    else:
        digits = repr(float(shortest) / 10.0 ** int(exponent))
    return f"{digits if '.' in digits else digits + '.0'}E{int(exponent)}"


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, raw = cell.get("t", "n"), cell.findtext(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    if raw is None:
        return ""
    computed = cell.find(f"{S}f") is not None
    if kind == "s":
        return shared[int(raw)]
    if kind == "str":
        return f'"{raw}"' if computed else raw
    if kind == "b":
        word = "true" if raw == "1" else "false"
        return word.upper() if computed else word
    return raw if kind == "e" else _java_double(float(raw))


def xlsx_text(archive: zipfile.ZipFile) -> str:
    """Per sheet a header line, then one line per row; each filled cell ends with a tab."""
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        items = _xml(archive, "xl/sharedStrings.xml").findall(f"{S}si")
        shared = ["".join(t.text or "" for t in item.iter(f"{S}t")) for item in items]
    targets = _targets(archive, "xl/workbook.xml")
    out = []
    for sheet in _xml(archive, "xl/workbook.xml").iter(f"{S}sheet"):
        out.append(f"{SHEET_LABEL}{sheet.get('name')}\n")
        for row in _xml(archive, targets[sheet.get(f"{R}id")]).iter(f"{S}row"):
            cells = [_cell_text(c, shared) for c in row.findall(f"{S}c")]
            line = "".join(f"{c}\t" for c in cells if c.strip())
            if line:
                out.append(line + "\n")
        out.append("\n")
    return "".join(out)


def pptx_text(archive: zipfile.ZipFile) -> str:
    """Per slide a header line, then one line per text run."""
    targets = _targets(archive, "ppt/presentation.xml")
    out = []
    slides = _xml(archive, "ppt/presentation.xml").iter(f"{P}sldId")
    for number, slide in enumerate(slides, 1):
        runs = (t.text or "" for t in _xml(archive, targets[slide.get(f"{R}id")]).iter(f"{A}t"))
        out.append(f"{SLIDE_LABEL}{number}:\n")
        out.extend(f"{run}\n" for run in runs if run.strip())
        out.append("\n")
    return "".join(out)


_READERS = {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text}


def extract_one(name: str, content: bytes) -> dict:
    reader = _READERS.get(name.rsplit(".", 1)[-1].lower())
    if reader is None:
        return {"text": None, "error": "unsupported file type"}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return {"text": reader(archive), "error": None}
    except Exception as error:  # one damaged file must not end the job
        return {"text": None, "error": f"{type(error).__name__}: {error}"}


def extract_office(name: Column, content: Column) -> Column:
    """``struct<text, error>`` of a docx, xlsx or pptx; NULL content gives NULL."""

    @once(EXTRACT_SCHEMA)
    def extract(names: pa.Array, contents: pa.Array) -> pa.Array:
        rows = (
            None if content.as_py() is None else extract_one(name.as_py() or "", content.as_py())
            for name, content in zip(names, contents)
        )
        return pa.array(rows, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return extract(name, content)
