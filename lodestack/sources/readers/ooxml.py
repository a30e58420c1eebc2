"""DOCX, PPTX and XLSX: zipped XML, read with the standard library."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

from .registry import Extraction, register

# Fixed values of the format: namespaces.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _open(raw: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(raw))


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id to (type's last word, part) for what ``part`` refers to."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)):
        target = r.get("Target", "")
        out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
    return out


def _run_text(run: ET.Element) -> str:
    out = []
    for x in run:
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag in (f"{W}tab", f"{W}ptab"):
            out.append("\t")
        elif x.tag == f"{W}cr" or (x.tag == f"{W}br" and x.get(f"{W}type", "textWrapping") == "textWrapping"):
            out.append("\n")
        elif x.tag == f"{W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def _paragraph(p: ET.Element) -> str:
    """The text of runs, also in hyperlinks."""
    out = []
    for x in p:
        if x.tag == f"{W}r":
            out.append(_run_text(x))
        elif x.tag == f"{W}hyperlink":
            out += [_run_text(r) for r in x.findall(f"{W}r")]
    return "".join(out)


def _rows(table: ET.Element) -> list[list[str]]:
    """Cell texts; a merged cell's text stands in each place it covers."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
            text = "\n".join(_paragraph(p) for p in tc.findall(f"{W}p")).strip()
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row += [text] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
        rows.append(row)
    return rows


def _notes(z: zipfile.ZipFile, part: str, kind: str) -> list[str]:
    if part not in z.namelist():
        return []
    out = []
    for note in ET.fromstring(z.read(part)).iter(f"{W}{kind}"):
        text = "".join((x.strip() for x in note.itertext()))
        if note.get(f"{W}id", "") not in ("-1", "0") and text:
            out.append(text)
    return out


@register(".docx")
def read_docx(raw: bytes, extension: str) -> Extraction:
    with _open(raw) as z:
        root = ET.fromstring(z.read("word/document.xml"))
        body = root.find(f"{W}body")
        parts = []
        for child in body if body is not None else ():
            if child.tag == f"{W}p":
                text = _paragraph(child)
                if text.strip():
                    parts.append(text)
            elif child.tag == f"{W}tbl":
                parts += [" | ".join(row) for row in _rows(child)]
        relations = _relations(z, "word/document.xml")
        current: dict[tuple[str, str], str] = {}
        for section in root.iter(f"{W}sectPr"):
            for kind in ("header", "footer"):
                for reference in section.findall(f"{W}{kind}Reference"):
                    current[kind, reference.get(f"{W}type", "default")] = relations.get(reference.get(f"{R}id", ""), ("", ""))[1]
            for kind, label in (("header", "[en-tête]"), ("footer", "[pied de page]")):
                for place in ("default", "first", "even"):
                    part = current.get((kind, place))  # a section without its own takes over the one before
                    if part in z.namelist():
                        parts += [f"{label} {text}" for p in ET.fromstring(z.read(part)).findall(f"{W}p") if (text := _paragraph(p)).strip()]
        for label, found in (
            ("[notes de bas de page]", _notes(z, "word/footnotes.xml", "footnote")),
            ("[notes de fin]", _notes(z, "word/endnotes.xml", "endnote")),
            ("[zones de texte]", [t for x in root.iter(f"{W}txbxContent") if (t := "".join(s.strip() for s in x.itertext()))]),
        ):
            if found:
                parts.append(label + "\n" + "\n".join(found))
        images = sum(n.startswith("word/media/") for n in z.namelist())
    return Extraction(text="\n\n".join(parts), image_count=images, file_type="docx")


def _a_paragraph(p: ET.Element) -> str:
    out = []
    for x in p:
        if x.tag in (f"{A}r", f"{A}fld"):
            out.append("".join(t.text or "" for t in x.findall(f"{A}t")))
        elif x.tag == f"{A}br":
            out.append("\v")
    return "".join(out)


@register(".pptx")
def read_pptx(raw: bytes, extension: str) -> Extraction:
    with _open(raw) as z:
        deck = ET.fromstring(z.read("ppt/presentation.xml"))
        relations = _relations(z, "ppt/presentation.xml")
        slides = [relations[s.get(f"{R}id")][1] for s in deck.iter(f"{P}sldId")]
        parts = []
        for number, part in enumerate(slides, 1):
            root = ET.fromstring(z.read(part))
            tree = root.find(f"{P}cSld/{P}spTree")
            found = []
            for shape in tree if tree is not None else ():
                if shape.tag == f"{P}sp":
                    found += [t for p in shape.findall(f"{P}txBody/{A}p") if (t := _a_paragraph(p).strip())]
                elif shape.tag == f"{P}graphicFrame":
                    for row in shape.iter(f"{A}tr"):
                        found.append(" | ".join("\n".join(_a_paragraph(p) for p in c.findall(f"{A}txBody/{A}p")).strip() for c in row.findall(f"{A}tc")))
            for kind, notes in _relations(z, part).values():
                if kind == "notesSlide" and notes in z.namelist():
                    for shape in ET.fromstring(z.read(notes)).iter(f"{P}sp"):
                        holder = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                        text = "\n".join(_a_paragraph(p) for p in shape.findall(f"{P}txBody/{A}p")).strip()
                        if holder is not None and holder.get("type") == "body" and text:
                            found.append(f"[Notes] {text}")
            parts.append(f"## Diapo {number}\n\n" + "\n\n".join(found or [f"[[DIAPO {number}: aucun texte extractible]]"]))
        images = sum(n.startswith("ppt/media/") for n in z.namelist())
    return Extraction(text="\n\n---\n\n".join(parts), image_count=images, page_count=len(slides), file_type="pptx")


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _dated(style: str) -> bool:
    """Whether a number format shows a date or time: letters of one, outside quotes and brackets."""
    return bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", style.lower())))


def _value(cell: ET.Element, shared: list[str], dates: set[int], base: datetime.datetime) -> str:
    kind, v = cell.get("t", "n"), cell.find(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind != "n":
        return v.text
    number = float(v.text)
    if int(cell.get("s", "0")) in dates:
        moment = base + datetime.timedelta(milliseconds=round(number * 86_400_000))
        return str(moment.time()) if 0 <= number < 1 else str(moment)
    return str(int(number)) if re.fullmatch(r"-?\d+", v.text) else str(number)


@register(".xlsx")
def read_xlsx(raw: bytes, extension: str) -> Extraction:
    with _open(raw) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        relations = _relations(z, "xl/workbook.xml")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for r in ([si] if si.find(f"{S}t") is not None else si.findall(f"{S}r")) for t in r.findall(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        dates: set[int] = set()
        if "xl/styles.xml" in z.namelist():
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{S}numFmt")}
            formats = styles.find(f"{S}cellXfs")
            for i, xf in enumerate(formats if formats is not None else ()):
                n = int(xf.get("numFmtId", "0"))
                if 14 <= n <= 22 or 45 <= n <= 47 or (n in own and _dated(own[n])):
                    dates.add(i)
        setting = book.find(f"{S}workbookPr")
        base = datetime.datetime(1904, 1, 1) if setting is not None and setting.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
        parts, sheets = [], book.findall(f"{S}sheets/{S}sheet")
        for sheet in sheets:
            rows = []
            for row in ET.fromstring(z.read(relations[sheet.get(f"{R}id")][1])).iter(f"{S}row"):
                cells: list[str] = []
                for c in row.findall(f"{S}c"):
                    place = _column(c.get("r", "")) or len(cells) + 1
                    cells += [""] * (place - 1 - len(cells)) + [_value(c, shared, dates, base)]
                rows.append(cells)
            width = max((len(r) for r in rows), default=0)
            lines = [" | ".join(r + [""] * (width - len(r))) for r in rows if any(c.strip() for c in r)]
            parts.append(f"### Feuille : {sheet.get('name')}\n\n" + ("\n".join(lines) or "[Feuille vide]"))
    return Extraction(text="\n\n".join(parts), page_count=len(sheets), file_type="xlsx")
