"""Files as rows: sniffing, text decoding, CSV, Word, Excel, HWPX and PDF documents, plain text.

``parse_files`` reads a folder with the binaryFile source and parses each file inside a task; a file
that cannot be read becomes a row with ok = false and a warning, never an error.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.sources.pdf import read_pdf

MAX_ENTRY, MAX_DOCUMENT, MAX_CELLS = 256 << 20, 512 << 20, 2_000_000
SCHEMA = "ok boolean, name string, kind string, size long, paragraphs array<string>, tables array<array<array<string>>>, sheets array<struct<name:string,rows:array<array<string>>>>, warnings array<string>, sha256 string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sniff(content: Column) -> Column:
    """zip, pdf, hwp5 or text, by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.isin("504B0304", "504B0506", "504B0708"), "zip").when(head == "25504446", "pdf").when(head == "D0CF11E0", "hwp5").otherwise("text")


def decode(data: bytes) -> str:
    """Strict UTF-8, else EUC-KR, else UTF-8 with replacements."""
    for codec in ("utf-8-sig", "euc_kr"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def looks_like_csv(text: str) -> bool:
    lines = [x for x in text.splitlines() if x.strip()][:10]
    counts = {x.count(",") for x in lines}
    return len(lines) >= 2 and len(counts) == 1 and counts.pop() >= 1


def csv_rows(text: str) -> list[list[str]]:
    """Rows as they stand: quotes and escapes undone, no header, no types, ragged rows kept."""
    return [row or [""] for row in csv.reader(io.StringIO(text.replace("\r\n", "\n").replace("\r", "")))]


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MAX_ENTRY:
        raise ValueError(f"{name} is too large")
    return z.read(name)


def _word_text(node) -> str:
    return "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in node.iter())


def read_docx(z: zipfile.ZipFile) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraphs outside tables, and tables as rows of cell texts."""
    body = ElementTree.fromstring(_member(z, "word/document.xml")).find(f"{_W}body")
    tables = [[[" ".join(filter(None, (_word_text(p).strip() for p in cell.iter(f"{_W}p")))) for cell in row.iter(f"{_W}tc")] for row in t.iter(f"{_W}tr")] for t in body.iter(f"{_W}tbl")]
    return [s for p in body.findall(f"{_W}p") if (s := _word_text(p).strip())], tables


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def read_xlsx(z: zipfile.ZipFile) -> list[dict]:
    """Sheets with their rows; cells that are missing in between are empty."""
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(_member(z, "xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    book = ElementTree.fromstring(_member(z, "xl/workbook.xml"))
    titles = [s.get("name") for s in book.iter(f"{_S}sheet")]
    parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out, cells = [], 0
    for title, part in zip(titles, parts):
        rows: list[list[str]] = []
        for row in ElementTree.fromstring(_member(z, part)).iter(f"{_S}row"):
            line: list[str] = []
            for c in row.findall(f"{_S}c"):
                at = _column(c.get("r", "")) if c.get("r") else len(line)
                cells += 1
                if cells > MAX_CELLS or at > 16383:
                    raise ValueError("too many cells")
                raw = c.findtext(f"{_S}v") or ""
                value = shared[int(raw)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else raw
                line += [""] * (at - len(line)) + [value]
            rows.append(line)
        out.append({"name": title, "rows": rows})
    return out


def read_hwpx(z: zipfile.ZipFile) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraphs outside tables and tables of all sections, in order of the section files' names."""
    local = lambda node: node.tag.rpartition("}")[2]
    said = lambda node: "".join(t.text or "" for t in node.iter() if local(t) == "t").strip()
    paragraphs, tables = [], []
    for part in sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)):
        root = ElementTree.fromstring(_member(z, part))
        own = [t for t in root.iter() if local(t) == "tbl"]
        inside = {p for t in own for p in t.iter() if local(p) == "p"}
        tables += [[[said(c) for c in row.iter() if local(c) == "tc"] for row in t.iter() if local(row) == "tr"] for t in own]
        for p in root.iter():
            if local(p) == "p" and p not in inside:
                held = {x for t in p.iter() if local(t) == "tbl" for x in t.iter()}
                if s := "".join(t.text or "" for t in p.iter() if local(t) == "t" and t not in held).strip():
                    paragraphs.append(s)
    return paragraphs, tables


def parse_bytes(name: str, data: bytes) -> dict:
    """One file as a row; any failure is a warning."""
    import hashlib

    out = {"ok": True, "name": name, "kind": "text", "size": len(data), "paragraphs": [], "tables": [], "sheets": [], "warnings": [], "sha256": hashlib.sha256(data).hexdigest()}
    try:
        if len(data) > MAX_DOCUMENT:
            raise ValueError("document is too large")
        if data[:4] == b"\xd0\xcf\x11\xe0":
            out["kind"] = "hwp5"
            raise ValueError("hwp5 is not supported")
        if data[:4] == b"%PDF":
            out["kind"] = "pdf"
            lines, _, out["warnings"] = read_pdf(data)
            out["paragraphs"] = [" ".join(x.split()) for x in lines]
            return out
        if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
            out["kind"] = "zip"
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if "word/document.xml" in z.namelist():
                    out["kind"] = "docx"
                    out["paragraphs"], out["tables"] = read_docx(z)
                elif "xl/workbook.xml" in z.namelist():
                    out["kind"] = "xlsx"
                    out["sheets"] = read_xlsx(z)
                elif any(re.fullmatch(r"Contents/section\d+\.xml", n) for n in z.namelist()):
                    out["kind"] = "hwpx"
                    out["paragraphs"], out["tables"] = read_hwpx(z)
                else:
                    raise ValueError("no known document in the archive")
            return out
        text = decode(data)
        if name.lower().endswith(".csv") or looks_like_csv(text):
            out["kind"], out["tables"] = "csv", [csv_rows(text)]
        else:
            out["paragraphs"] = [s for x in text.splitlines() if (s := " ".join(x.split()))]
    except Exception as e:  # a broken file is a result, whatever breaks
        out |= {"ok": False, "warnings": [f"{type(e).__name__}: {e}"[:200]]}
    return out


def parse_frame(files: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """Parsed rows of (name, content) files, a row a file."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([parse_bytes(str(n or ""), bytes(c or b"")) for n, c in zip(pdf.iloc[:, 0], pdf.iloc[:, 1])], columns=[x.split()[0] for x in re.split(r", (?=[a-z0-9]+ )", SCHEMA)])

    return files.select(name_col, content_col).mapInPandas(run, SCHEMA)


def parse_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder, junk names left out; the source yields no row for a file of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return parse_frame(files.where(~tx.is_junk_name(F.element_at(F.split("path", "/"), -1))))


def cells(parsed: DataFrame) -> DataFrame:
    """(name, t, r, c, v): all tables and sheets as cells."""
    union = F.concat("tables", F.transform("sheets", lambda s: s["rows"]))
    rows = parsed.select("name", F.posexplode(union).alias("t", "rows")).select("name", "t", F.posexplode("rows").alias("r", "row"))
    return rows.select("name", "t", "r", F.posexplode("row").alias("c", "v"))
