"""The text layer of a PDF file: its strings in content-stream order, through each font's Unicode map."""

from __future__ import annotations

import re
import zlib

MAX_STREAM = 256 << 20
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_FONT = re.compile(rb"/([A-Za-z][^\s/<>\[\]()]*)\s+(\d+)\s+\d+\s+R")
_HEX = rb"<\s*([0-9A-Fa-f\s]*)>"
_PAIR, _RANGE = re.compile(_HEX + rb"\s*" + _HEX), re.compile(_HEX + rb"\s*" + _HEX + rb"\s*(?:" + _HEX + rb"|\[([^\]]*)\])")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|\r?\n|(.))", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: operators that start a new line
_BREAKS = {b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"ET"}


def inflate(data: bytes) -> bytes:
    out = zlib.decompressobj()
    return out.decompress(data, MAX_STREAM)


def unhex(digits: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes a code has, code to text) of a ToUnicode map."""
    found: dict[int, str] = {}
    text = lambda h: unhex(h).decode("utf-16-be", "replace")
    width = max([len(unhex(m[0])) for m in re.findall(_HEX + rb"\s*" + _HEX, b"".join(re.findall(rb"begincodespacerange(.*?)endcodespacerange", cmap, re.S)))] or [1])
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        found |= {int(a, 16): text(b) for a, b in _PAIR.findall(part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, first, listed in _RANGE.findall(part):
            codes = range(int(low, 16), min(int(high, 16), int(low, 16) + 65535) + 1)
            if listed:
                found |= {c: text(t) for c, t in zip(codes, re.findall(_HEX, listed))}
            elif start := text(first):
                found |= {c: start[:-1] + chr(min(ord(start[-1]) + k, 0x10FFFF)) for k, c in enumerate(codes)}
    return width, found


def string_bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        return unhex(token[1:-1])
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _PLAIN.get(m[2], m[2]) if m[2] else b"", token[1:-1])


def shown(raw: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if not font or not font[1]:
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
    width, known = font
    return "".join(known.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))


def content_lines(stream: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> list[str]:
    lines, strings, font, name = [""], [], None, b""
    for token in _TOKEN.findall(stream):
        first = token[:1]
        if first in b"(<":
            strings.append(shown(string_bytes(token), font))
        elif first == b"/":
            name = token[1:]
        elif token == b"Tf":
            font = fonts.get(name)
        elif first.isalpha() or first in b"'\"":
            if token in _BREAKS and lines[-1]:
                lines.append("")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                lines[-1] += "".join(strings)
            strings = []
        elif strings and first == b"-" and float(token) < -200:
            strings.append(" ")  # a wide gap inside an array of strings
    return [x for x in lines if x.strip()]


def read_pdf(data: bytes) -> tuple[list[str], int, list[str]]:
    """(lines, pages, warnings); encrypted files raise ValueError."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("encrypted PDF")
    bodies: dict[int, tuple[bytes, bytes]] = {}
    for number, body in _OBJECT.findall(data):
        head, stream = body, b""
        if m := _STREAM.search(body):
            head, stream = body[: m.start()], m[1]
            if b"/FlateDecode" in head:
                try:
                    stream = inflate(stream)
                except zlib.error:
                    stream = b""
        bodies[int(number)] = (head, stream)
    if not bodies:
        raise ValueError("no objects in the PDF")
    for head, stream in list(bodies.values()):  # objects packed in streams
        if b"/ObjStm" in head and (n := re.search(rb"/N\s+(\d+)", head)) and (first := re.search(rb"/First\s+(\d+)", head)):
            numbers = [int(x) for x in stream[: int(first[1])].split()[: 2 * int(n[1])]]
            starts = [int(first[1]) + x for x in numbers[1::2]] + [len(stream)]
            for number, a, b in zip(numbers[::2], starts, starts[1:]):
                bodies.setdefault(number, (stream[a:b], b""))
    fonts: dict[bytes, tuple[int, dict[int, str]]] = {}
    for head, _ in bodies.values():
        for name, ref in _FONT.findall(head):
            if (m := re.search(rb"/ToUnicode\s+(\d+)", bodies.get(int(ref), (b"", b""))[0])) and name != b"ToUnicode":
                fonts[name] = unicode_map(bodies.get(int(m[1]), (b"", b""))[1])
    pages = sum(bool(re.search(rb"/Type\s*/Page\b(?!s)", head)) for head, _ in bodies.values())
    lines = [x for _, stream in bodies.values() if b"BT" in stream and re.search(rb"\bT[jJ]\b|['\"]\s", stream) for x in content_lines(stream, fonts)]
    return lines, pages, [] if lines else ["no text layer"]
