"""Small files of each format, made with the standard library."""

from __future__ import annotations

import io
import zipfile
import zlib

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def relations(*rows: tuple[str, str, str]) -> str:
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="{i}" Type="{TYPE}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(body: str | None = None) -> bytes:
    body = body or (
        p("Titre") + p(" ") + '<w:p><w:r><w:t>un</w:t><w:tab/><w:t>deux</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>lien</w:t></w:r></w:hyperlink></w:p>'
        f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p(' b ')}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>{p('c')}</w:tc></w:tr></w:tbl>"
        f"<w:p><w:r><w:txbxContent>{p('boîte')}</w:txbxContent></w:r></w:p>"
        '<w:sectPr><w:headerReference w:type="default" r:id="h"/><w:footerReference w:type="default" r:id="f"/></w:sectPr>'
    )
    return zipped({
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": relations(("h", "header", "header1.xml"), ("f", "footer", "footer1.xml")),
        "word/header1.xml": f"<w:hdr {W}>{p('haut')}</w:hdr>", "word/footer1.xml": f"<w:ftr {W}>{p('bas')}</w:ftr>",
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="-1">{p("sep")}</w:footnote><w:footnote w:id="2">{p("note")}</w:footnote></w:footnotes>',
        "word/media/image1.png": b"x",
    })


def pptx() -> bytes:
    sp = lambda *lines: "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:txBody></p:sp>"
    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>" for x in "xy") + "</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    notes = f'<p:notes {A}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>dire</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
    slide = lambda inner: f"<p:sld {A}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(("a", "slide", "slides/slide1.xml"), ("b", "slide", "slides/slide2.xml")),
        "ppt/slides/slide2.xml": slide(sp("Titre", " ", "corps") + table), "ppt/slides/slide1.xml": slide(""),
        "ppt/slides/_rels/slide2.xml.rels": relations(("n", "notesSlide", "../notesSlides/n1.xml")), "ppt/notesSlides/n1.xml": notes, "ppt/media/i.png": b"x",
    })


def xlsx() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return zipped({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="Un" r:id="a"/><sheet name="Deux" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("a", "worksheet", "worksheets/s1.xml"), ("b", "worksheet", "/xl/worksheets/s2.xml")),
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>nom</t></si><si><r><t>ri</t></r><r><t>che</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>3</v></c><c r="B2"><v>2.5</v></c><c r="C2" s="1"><v>45292</v></c></row><row><c r="A3" t="b"><v>1</v></c></row><row/></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f"<worksheet {ns}><sheetData/></worksheet>",
    })


def odt() -> bytes:
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    inner = (
        "<text:h>Titre</text:h><text:p>un <text:span>deux</text:span></text:p><text:p/><table:table><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell>"
        "<table:table-cell><text:p>b</text:p></table:table-cell></table:table-row></table:table><text:list><text:list-item><text:p>i</text:p></text:list-item></text:list>"
    )
    return zipped({"content.xml": f"<office:document-content {ns}><office:body><office:text>{inner}</office:text></office:body></office:document-content>", "Pictures/a.png": b"x"})


def pdf(pages=(b"(Bonjour) Tj", b""), encrypted=False, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", extra=()) -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)), 3: font}
    for i, ops in enumerate(pages):
        data = zlib.compress(b"BT /F1 12 Tf 72 700 Td " + ops + b" ET /Im Do" if ops else b"")
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im 4 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)
    objects[4] = b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\nx\nendstream"
    objects |= dict(extra)
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    return body + b"trailer\n<< /Root 1 0 R %s >>\n%%%%EOF" % (b"/Encrypt << /Filter /Standard >>" if encrypted else b"")
