"""Rows as files: reproducible ZIP archives, Word and Excel documents, backups with a verified restore."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names and parts that the file formats ask for.
_EPOCH = (1980, 1, 1, 0, 0, 0)
_DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def zip_bytes(files: dict[str, bytes]) -> bytes:
    """A stored ZIP whose bytes depend on names and contents only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, _EPOCH), data)
    return out.getvalue()


def _clean(text) -> str:
    return escape("".join(c for c in str(text) if c >= " " or c in "\t\n"))


def docx_bytes(blocks: list[dict]) -> bytes:
    """A Word document of blocks {kind: h1|h2|p|table, text | rows}."""

    def para(text, style=""):
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{_clean(text)}</w:t></w:r></w:p>'

    body = []
    for b in blocks:
        if b["kind"] == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{para(v)}</w:tc>" for v in row) + "</w:tr>" for row in b["rows"])
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            style = f'<w:pPr><w:pStyle w:val="Heading{b["kind"][1]}"/></w:pPr>' if b["kind"][0] == "h" else ""
            body.append(para(b["text"], style))
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    return zip_bytes({"[Content_Types].xml": types.encode(), "word/document.xml": _DOC.format("".join(body)).encode()})


def column_name(n: int) -> str:
    """A, B, … Z, AA for 0, 1, … 25, 26."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx_bytes(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A workbook; numbers are numeric cells, all else inline text of at most 32,000 characters."""

    def cell(r, c, v):
        ref = f"{column_name(c)}{r + 1}"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
            return f'<c r="{ref}"><v>{v:g}</v></c>' if isinstance(v, float) and abs(v) < 1e6 and float(f"{v:g}") == v else f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_clean("" if v is None else v)[:32000]}</t></is></c>'

    files = {}
    names = []
    for k, (name, rows) in enumerate(sheets, 1):
        names.append(f'<sheet name="{_clean("".join("_" if c in "[]:*?/" + chr(92) else c for c in name)[:31])}" sheetId="{k}"/>')
        data = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
        files[f"xl/worksheets/sheet{k}.xml"] = _SHEET.format(data).encode()
    book = f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets>{"".join(names)}</sheets></workbook>'
    return zip_bytes({"xl/workbook.xml": book.encode(), **files})


def note_documents(notes: DataFrame, id_col: str, lines: str) -> DataFrame:
    """(name, content): a Word document for each note, from an array column of its lines; made inside tasks."""

    def run(batches):
        for pdf in batches:
            blocks = [[{"kind": "h1", "text": i}, *({"kind": "p", "text": x} for x in text)] for i, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1])]
            yield pd.DataFrame({"name": [f"{i}.docx" for i in pdf.iloc[:, 0]], "content": [docx_bytes(b) for b in blocks]})

    return notes.select(id_col, lines).mapInPandas(run, "name string, content binary")


def manifest(files: DataFrame) -> DataFrame:
    """(name, bytes, sha256) of (name, content) files."""
    return files.select("name", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def backup_zip(files: dict[str, bytes]) -> bytes:
    """One project's files as a ZIP with a manifest of their hashes."""
    listed = [{"path": n, "bytes": len(d), "sha256": hashlib.sha256(d).hexdigest()} for n, d in sorted(files.items())]
    return zip_bytes({"manifest.json": json.dumps({"files": listed}, ensure_ascii=False).encode(), **dict(sorted(files.items()))})


def restore_zip(data: bytes) -> dict[str, bytes]:
    """The files of a backup, all of them verified before any is returned."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        listed = json.loads(z.read("manifest.json"))["files"]
        files = {f["path"]: z.read(f["path"]) for f in listed}
    bad = [f["path"] for f in listed if hashlib.sha256(files[f["path"]]).hexdigest() != f["sha256"]]
    if bad:
        raise ValueError(f"changed since the backup: {bad[:5]}")
    return files


def archive(notes: DataFrame, path: str, period_end: str = "end") -> None:
    """Sealed notes as JSON, a folder a year."""
    notes.where("state = 'sealed'").withColumn("year", F.year(period_end)).write.partitionBy("year").mode("append").json(path)
