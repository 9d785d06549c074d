"""Text of DOCX files, and simple DOCX files of texts, with the standard library's zip and XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _styled(p: ET.Element, keep: bool) -> str:
    """With marks for headings, titles and quotes."""
    text = _text(p)
    style = p.find(f"{W}pPr/{W}pStyle")
    name = style.get(f"{W}val", "") if style is not None else ""
    if not keep or not text.strip():
        return text
    if m := re.fullmatch(r"Heading ?(\d+)", name):
        return "#" * int(m[1]) + " " + text
    return f"# {text}" if name == "Title" else f"> {text}" if name == "Quote" else text


def _table(t: ET.Element, separator: str) -> list[str]:
    rows = []
    for r in t.findall(f"{W}tr"):
        rows.append(separator.join(" ".join(x for x in (_text(p).strip() for p in c.findall(f"{W}p")) if x) for c in r.findall(f"{W}tc")))
    return ["[TABLE]", *rows, "[/TABLE]"]


def _metadata(z: zipfile.ZipFile) -> list[str]:
    if "docProps/core.xml" not in z.namelist():
        return []
    core = {e.tag.rpartition("}")[2]: e.text for e in ET.fromstring(z.read("docProps/core.xml")) if e.text}
    names = {"title": "Title", "creator": "Author", "subject": "Subject", "created": "Created", "modified": "Modified", "lastModifiedBy": "Last Modified By"}
    lines = [f"{label}: {core[k]}" for k, label in names.items() if k in core]
    return ["[METADATA]", *lines, "[/METADATA]", ""] if lines else []


def read(data: bytes, preserve_formatting: bool = False, headers_footers: bool = True, metadata: bool = False, table_separator: str = " | ", clean: bool = True, drop_blank: bool = True) -> str:
    """Headers, footers, then paragraphs and tables in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        lines = _metadata(z) if metadata else []
        if headers_footers:
            marked = []
            for part, mark in (("header", "[HEADER] "), ("footer", "[FOOTER] ")):
                for name in sorted(n for n in z.namelist() if re.fullmatch(rf"word/{part}\d*\.xml", n)):
                    marked += [mark + t for p in ET.fromstring(z.read(name)).iter(f"{W}p") if (t := _text(p).strip())]
            lines += [*marked, ""] if marked else []
        for e in ET.fromstring(z.read("word/document.xml")).find(f"{W}body"):
            if e.tag == f"{W}p":
                lines.append(_styled(e, preserve_formatting))
            elif e.tag == f"{W}tbl":
                lines += _table(e, table_separator)
    lines = "\n".join(lines).split("\n")
    if clean:
        lines = [" ".join(x.split()) for x in lines]
    if drop_blank:
        lines = [x for x in lines if x.strip()]
    return "\n".join(lines)


def _part(name: str, body: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{body}'


def write(text: str, title: str = "Scrubbed Document") -> bytes:
    """A heading and a paragraph for each line that isn't blank."""

    def p(line: str, style: str = "") -> str:
        return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'

    body = p(title, "Heading1") + "".join(p(x) for x in text.split("\n") if x.strip())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, xml: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _part(name, xml))
        put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        put("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        put("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
