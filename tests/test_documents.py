"""PDF text layers, HWPX sections, and files that are broken in any way."""

from __future__ import annotations

import random
import zlib

import pytest

from fieldbook.sources import export, parse

CMAP = b"""1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <ACFC> <0002> <C81C> endbfchar
2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<BA85> <003A>] endbfrange"""


def pdf(content: bytes, flate: bool, extra: bytes = b"") -> bytes:
    def stream(data):
        return b"<< " + (b"/Filter /FlateDecode " if flate else b"") + b">>\nstream\n" + (zlib.compress(data) if flate else data) + b"\nendstream"

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 7 0 R >> >> >>", stream(content), b"<< /Type /Font /ToUnicode 6 0 R >>", stream(CMAP), b"<< /Type /Font >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R " + extra + b">>\n%%EOF"


@pytest.mark.parametrize("flate", [True, False])
def test_pdf_text(flate):
    content = rb"BT /F1 12 Tf 0 700 Td <000100020020> Tj /F2 9 Tf 0 -14 Td [(Hel) -20 (lo) -400 (\(x\) \101)] TJ T* (next) ' ET BT /F1 9 Tf 1 0 0 1 5 5 Tm <00100011001200210010> Tj ET"
    out = parse.parse_bytes("a.pdf", pdf(content, flate))
    assert out["ok"] and out["kind"] == "pdf" and out["paragraphs"] == ["과제명", "Hello (x) A", "next", "ABC:A"] and not out["warnings"]


def test_pdf_without_text_and_encrypted():
    scanned = parse.parse_bytes("a.pdf", pdf(b"q 1 0 0 1 0 0 cm /Im1 Do Q", True))
    assert scanned["ok"] and scanned["warnings"] == ["no text layer"]
    assert not parse.parse_bytes("a.pdf", pdf(b"BT (x) Tj ET", True, b"/Encrypt 9 0 R "))["ok"]
    assert not parse.parse_bytes("a.pdf", b"%PDF-")["ok"]


def test_hwpx():
    ns = 'xmlns:hs="s" xmlns:hp="p"'
    table = "<hp:p><hp:run><hp:tbl><hp:tr><hp:tc><hp:p><hp:run><hp:t>성능지표</hp:t></hp:run></hp:p></hp:tc><hp:tc><hp:p><hp:run><hp:t>95</hp:t></hp:run></hp:p></hp:tc></hp:tr></hp:tbl></hp:run></hp:p>"
    first = f"<hs:sec {ns}><hp:p><hp:run><hp:t>과제명: </hp:t><hp:t>시험</hp:t></hp:run></hp:p>{table}</hs:sec>"
    second = f"<hs:sec {ns}><hp:p><hp:run><hp:t>둘째 &amp; 끝</hp:t></hp:run></hp:p></hs:sec>"
    out = parse.parse_bytes("a.hwpx", export.zip_bytes({"Contents/section1.xml": second.encode(), "Contents/section0.xml": first.encode()}))
    assert out["ok"] and out["kind"] == "hwpx" and out["paragraphs"] == ["과제명: 시험", "둘째 & 끝"] and out["tables"] == [[["성능지표", "95"]]]


def test_broken_bytes_never_raise():
    rng = random.Random(7)
    whole = [export.docx_bytes([{"kind": "p", "text": "x" * 50}]), export.xlsx_bytes([("s", [["a", 1], ["b", 2]])]), pdf(b"BT /F1 9 Tf <0001> Tj ET", True), "가,나\n1,2\n".encode(), rng.randbytes(300)]
    for k in range(300):
        data = bytearray(whole[k % len(whole)])
        if k % 3 == 0:
            data = data[: rng.randrange(len(data))]
        else:
            for _ in range(1 + k % 7):
                data[rng.randrange(len(data))] = rng.randrange(256)
        out = parse.parse_bytes(f"f{k}.{('docx', 'xlsx', 'pdf', 'csv', 'txt')[k % 5]}", bytes(data))
        assert out["ok"] or out["warnings"]
