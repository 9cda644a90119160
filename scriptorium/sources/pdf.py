"""PDF files by the standard library: pages with an invisible text layer, and the text of files that have one.

The reader knows objects that stand in the file as such, content streams without a filter or with FlateDecode, the
text operators, literal and hexadecimal strings in single-byte encodings or UTF-16 with a mark. Encrypted files, object
streams and fonts with encodings of their own need a fuller extractor, which readers.extract takes as a parameter.
"""

from __future__ import annotations

import re
import zlib

_STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>"
_OPERATION = re.compile(
    rb"(?P<array>\[(?:[^\[\]()<>]|" + _STRING + rb")*\])\s*TJ|(?P<show>" + _STRING + rb")\s*(?P<how>Tj|'|\")|(?P<move>[-\d.]+\s+[-\d.]+\s+T[dD])|(?P<next>T\*)|(?P<place>(?:[-\d.]+\s+){6}Tm)", re.S
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _bytes_of(string: bytes) -> bytes:
    if string[:1] == b"<":
        digits = re.sub(rb"\s", b"", string[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, string[1:-1], flags=re.S)


def _text_of(data: bytes) -> str:
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """The strings that a content stream shows, with a line break where the line moves."""
    lines, line = [], ""
    for m in _OPERATION.finditer(content):
        moved = m["next"] or m["place"] or (m["move"] and float(m["move"].split()[1]) != 0) or m["how"] in (b"'", b'"')
        if moved and line:
            lines.append(line)
            line = ""
        if m["show"]:
            line += _text_of(_bytes_of(m["show"]))
        elif m["array"]:
            line += "".join(_text_of(_bytes_of(s)) for s in re.findall(_STRING, m["array"], re.S))
    return "\n".join([*lines, line] if line else lines)


def pdf_text(data: bytes) -> tuple[str, dict]:
    """The text layer, a form feed behind each content stream that shows any, and title, author, subject and keywords of the information dictionary."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    if b"/Encrypt" in data:
        raise ValueError("an encrypted PDF")
    found = []
    for m in re.finditer(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n", data, re.S):
        size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", m[1])
        end = m.end() + int(size[1]) if size else data.find(b"endstream", m.end())
        raw = data[m.end() : end]
        if b"/Filter" in m[1]:
            if b"/FlateDecode" not in m[1]:
                continue
            raw = zlib.decompress(raw)
        if b"BT" in raw:
            found.append(_shown(raw))
    about = {}
    for key, value in re.findall(rb"/(Title|Author|Subject|Keywords)\s*(" + _STRING + rb")", data, re.S):
        if text := _text_of(_bytes_of(value)).strip():
            about[key.decode().lower()] = text
    return "".join(x + "\n\f" for x in found if x), about


def _literal(text: str) -> bytes:
    return b"(" + re.sub(rb"([()\\])", rb"\\\1", text.encode("cp1252", "replace")).replace(b"\n", b"\\n").replace(b"\r", b"\\r") + b")"


def font_size(height: float) -> float:
    """The size of type that covers a line of that height."""
    return max(1.0, height * 0.75)


def searchable_pdf(pages: list[list[tuple[str, float, float, float, float]]], about: dict[str, str] | None = None, width: float = 612, height: float = 792, boxes: bool = False) -> bytes:
    """A PDF with an invisible text layer; boxes draws the outline of each line, to look at.

    pages: for each page its lines as text, left, top, width and height, from the upper left corner.
    """
    objects: list[bytes] = [b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for lines in pages:
        parts = []
        for text, left, top, w, h in lines:
            if boxes:
                parts.append(b"%.2f %.2f %.2f %.2f re S" % (left, height - top - h, w, h))
            parts.append(b"BT 3 Tr /F1 %.2f Tf 1 0 0 1 %.2f %.2f Tm %b Tj ET" % (font_size(h), left, height - top - h, _literal(text)))
        packed = zlib.compress(b"\n".join(parts))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(packed), packed))
        objects.append(b"<< /Type /Page /Parent 1 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << /F1 2 0 R >> >> /Contents %d 0 R >>" % (width, height, len(objects)))
        kids.append(len(objects))
    objects[0] = b"<< /Type /Pages /Count %d /Kids [%b] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    objects.append(b"<< /Type /Catalog /Pages 1 0 R >>")
    root = len(objects)
    objects.append(b"<< " + b" ".join(b"/%b %b" % (k.capitalize().encode(), _literal(v)) for k, v in (about or {}).items()) + b" >>")
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, root, root + 1, len(out))
