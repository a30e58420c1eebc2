"""Queries of the readers: a file of each format is made of every row of a table, read back, and its text returned.

The files are the least that each public format asks for, so that the text to be read from
them can be said in SQL.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import read

READ = "id long, text string, status string, image_count int, page_count int, encoding string, error_message string"

# Fixed values of the formats: namespaces of their XML.
_OOXML = "http://schemas.openxmlformats.org"
_RELATED = f"{_OOXML}/officeDocument/2006/relationships"
_WORD = f'xmlns:w="{_OOXML}/wordprocessingml/2006/main"'
_SLIDES = f'xmlns:a="{_OOXML}/drawingml/2006/main" xmlns:p="{_OOXML}/presentationml/2006/main" xmlns:r="{_RELATED}"'
_SHEETS = f'xmlns="{_OOXML}/spreadsheetml/2006/main" xmlns:r="{_RELATED}"'
_ODF = " ".join(f'xmlns:{x}="urn:oasis:names:tc:opendocument:xmlns:{x}:1.0"' for x in ("office", "text", "table"))


#: Files that are made and read by one task, where rows are dealt out; files whose texts are sent on at a time.
FILES, TEXTS = 4_000, 64


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow ``rows`` dealt out by count: a small table is one split, whatever its rows cost afterwards."""
    n = rows.count()
    return rows.repartition(max(1, min(n, n // FILES + rows.sparkSession.sparkContext.defaultParallelism)))


def read_back(df: DataFrame, id: str, extension: str, build: Callable[..., bytes] | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """What the reader for ``extension`` finds in a file of each row: that which ``build`` makes of the columns, or the one column's bytes."""
    import pyarrow as pa

    from ..shipping import ship
    from ..sources.readers import registry, safe_read

    readers = registry.snapshot()
    names = [c.split()[0] for c in READ.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in READ.split(", ")]

    def work(batches):
        registry.install(readers)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                ids, *values = (c.to_pylist() for c in b.slice(at, TEXTS).columns)
                found = [safe_read(bytes(r[0]) if build is None else build(*r), extension) for r in zip(*values, strict=True)]
                rows = [ids, *([getattr(f, n) for f in found] for n in names[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)

    ship(df.sparkSession)
    rows = df.select(F.col(id).cast("long").alias("id"), *columns)
    return (rows if build is None else dealt(rows)).mapInArrow(work, READ)


def _zip(**parts: str | bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def _relations(**targets: str) -> str:
    rows = "".join(f'<Relationship Id="{k}" Type="{_RELATED}/{t.split("/")[0].rstrip("s")}" Target="{t}"/>' for k, t in targets.items())
    return f'<Relationships xmlns="{_OOXML}/package/2006/relationships">{rows}</Relationships>'


def docx(name: str, key: int, segment: str) -> bytes:
    paragraph = lambda t: f"<w:p><w:r><w:t>{escape(str(t))}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = paragraph(name) + paragraph(" ") + f"<w:tbl>{row('clé', 'segment')}{row(key, segment)}</w:tbl>" + f"<w:p><w:r><w:t>fin</w:t><w:tab/><w:t>{key}</w:t></w:r></w:p>"
    return _zip(**{"word/document.xml": f"<w:document {_WORD}><w:body>{body}</w:body></w:document>", "word/media/a.png": b"x", "word/media/b.png": b"y"})


def pptx(name: str, key: int, segment: str) -> bytes:
    shape = f"<p:sp><p:txBody><a:p><a:r><a:t>{escape(name)}</a:t></a:r></a:p><a:p><a:r><a:t>{escape(segment)}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda inner: f"<p:sld {_SLIDES}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    order = '<p:sldId r:id="b"/><p:sldId r:id="a"/>' if key % 2 else '<p:sldId r:id="a"/><p:sldId r:id="b"/>'
    return _zip(**{
        "ppt/presentation.xml": f"<p:presentation {_SLIDES}><p:sldIdLst>{order}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _relations(a="slides/slide1.xml", b="slides/slide2.xml"),
        "ppt/slides/slide1.xml": slide(shape), "ppt/slides/slide2.xml": slide(""), "ppt/media/i.png": b"x",
    })


def xlsx(name: str, key: int, segment: str) -> bytes:
    cells = f'<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>{key}</v></c><c r="B2"><v>2.5</v></c><c r="C2" t="b"><v>{key % 2}</v></c></row>'
    return _zip(**{
        "xl/workbook.xml": f'<workbook {_SHEETS}><sheets><sheet name="Un" r:id="a"/><sheet name="Deux" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(a="worksheets/s1.xml", b="worksheets/s2.xml"),
        "xl/sharedStrings.xml": f"<sst {_SHEETS}><si><t>{escape(name)}</t></si><si><r><t>{escape(segment[:3])}</t></r><r><t>{escape(segment[3:])}</t></r></si></sst>",
        "xl/worksheets/s1.xml": f"<worksheet {_SHEETS}><sheetData>{cells}</sheetData></worksheet>",
        "xl/worksheets/s2.xml": f"<worksheet {_SHEETS}><sheetData/></worksheet>",
    })


def odt(name: str, key: int, segment: str) -> bytes:
    cell = lambda t: f"<table:table-cell><text:p>{escape(str(t))}</text:p></table:table-cell>"
    inner = (
        f"<text:h>{escape(name)}</text:h><text:p/><table:table><table:table-row>{cell(key)}{cell(segment)}</table:table-row></table:table>"
        f"<text:list><text:list-item><text:p>{escape(segment)}</text:p></text:list-item></text:list>"
    )
    return _zip(**{"content.xml": f"<office:document-content {_ODF}><office:body><office:text>{inner}</office:text></office:body></office:document-content>", "Pictures/a.png": b"x"})


def rtf(name: str, key: int, segment: str) -> bytes:
    return (r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}" + name + r"\par caf\'e9 " + "\\" + "u8364?" + str(key) + r"\tab \{" + segment + r"\}}").encode("latin-1")


def pdf(name: str, key: int, segment: str) -> bytes:
    pages = [f"({name}) Tj 0 -14 Td [({segment[:2]}) -300 ({segment[2:]})] TJ".encode()] + [b""] * (key % 3)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)
    for i, operators in enumerate(pages):
        data = zlib.compress(b"BT /F1 12 Tf 72 700 Td " + operators + b" ET" if operators else b"")
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def mhtml(name: str, key: int, segment: str) -> bytes:
    html = f"<html><head><title>t</title></head><body><h1>{escape(name)}</h1><p>{escape(segment)} <b>{key}</b></p><script>x()</script></body></html>"
    parts = [("text/html; charset=utf-8", html), ("image/png", "eA=="), ("text/css", "p {}")]
    body = "".join(f"--B\r\nContent-Type: {kind}\r\n" + ("Content-Transfer-Encoding: base64\r\n" if kind.startswith("image") else "") + f"\r\n{content}\r\n" for kind, content in parts)
    return f'MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="B"\r\n\r\n{body}--B--\r\n'.encode()


def html(name: str, key: int, segment: str) -> bytes:
    table = f"<table><tr><th>k</th><th>s</th></tr><tr><td>{key}</td><td>{escape(segment)}</td></tr></table>"
    listed = f"<ol><li>{key}</li><li>x</li></ol><ul><li>{escape(segment)}</li></ul>"
    images = f'<img src="a.png" alt="{escape(segment)}"><img src="b.png"><div>avant <img src="c.png" alt="i"> après</div>'
    return f"<html><head><style>p {{}}</style></head><body><h1>{escape(name)}</h1><h3></h3>{table}{listed}{images}<p>un <b>deux</b></p></body></html>".encode()


def eml(name: str, key: int, segment: str) -> bytes:
    head = f"Subject: {segment}\r\nFrom: a@example.org\r\nTo: b@example.org\r\nMIME-Version: 1.0\r\n"
    if key % 2:
        return (head + f"Content-Type: text/html; charset=utf-8\r\n\r\n<p>{escape(name)}</p><script>x()</script><p>fin</p>\r\n").encode()
    parts = f"--B\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n{name}\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>autre</p>\r\n--B--\r\n"
    return (head + f'Content-Type: multipart/alternative; boundary="B"\r\n\r\n{parts}').encode()


_COLUMNS = ("c_name", "c_custkey", "c_mktsegment")
#: Name of the query: reader, builder, and the SQL of the text, images and pages that it finds in each customer's file.
_FILES = {
    "docx_text": (".docx", docx, "c_name || chr(10) || chr(10) || 'clé | segment' || chr(10) || chr(10) || c_custkey || ' | ' || c_mktsegment || chr(10) || chr(10) || 'fin' || chr(9) || c_custkey", "2", "0"),
    "pptx_text": (
        ".pptx", pptx,
        "CASE WHEN c_custkey % 2 = 0 THEN '## Diapo 1' || chr(10) || chr(10) || c_name || chr(10) || chr(10) || c_mktsegment || chr(10) || chr(10) || '---' || chr(10) || chr(10)"
        " || '## Diapo 2' || chr(10) || chr(10) || '[[DIAPO 2: aucun texte extractible]]'"
        " ELSE '## Diapo 1' || chr(10) || chr(10) || '[[DIAPO 1: aucun texte extractible]]' || chr(10) || chr(10) || '---' || chr(10) || chr(10)"
        " || '## Diapo 2' || chr(10) || chr(10) || c_name || chr(10) || chr(10) || c_mktsegment END",
        "1", "2",
    ),
    "xlsx_text": (
        ".xlsx", xlsx,
        "'### Feuille : Un' || chr(10) || chr(10) || c_name || ' |  | ' || c_mktsegment || chr(10) || c_custkey || ' | 2.5 | ' || CASE WHEN c_custkey % 2 = 1 THEN 'True' ELSE 'False' END"
        " || chr(10) || chr(10) || '### Feuille : Deux' || chr(10) || chr(10) || '[Feuille vide]'",
        "0", "2",
    ),
    "odf_text": (".odt", odt, "c_name || chr(10) || c_custkey || ' | ' || c_mktsegment || chr(10) || '- ' || c_mktsegment", "1", "0"),
    "rtf_text": (".rtf", rtf, "c_name || chr(10) || 'café €' || c_custkey || chr(9) || '{' || c_mktsegment || '}'", "0", "0"),
    "pdf_text": (
        ".pdf", pdf,
        "c_name || chr(10) || substr(c_mktsegment, 1, 2) || ' ' || substr(c_mktsegment, 3) || CASE WHEN c_custkey % 3 > 0 THEN chr(10) || chr(10) || '[[PAGE 2: aucun texte extractible]]' ELSE '' END"
        " || CASE WHEN c_custkey % 3 > 1 THEN chr(10) || chr(10) || '[[PAGE 3: aucun texte extractible]]' ELSE '' END",
        "0", "1 + c_custkey % 3",
    ),
    "mhtml_text": (".mhtml", mhtml, "'t' || chr(10) || c_name || chr(10) || c_mktsegment || chr(10) || c_custkey", "1", "0"),
    "html_text": (
        ".html", html,
        "'# ' || c_name || chr(10) || chr(10) || '| k | s |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_mktsegment || ' |' || chr(10) || chr(10)"
        " || '1. ' || c_custkey || chr(10) || '2. x' || chr(10) || chr(10) || '- ' || c_mktsegment || chr(10) || chr(10) || '[image: ' || c_mktsegment || ']' || chr(10) || chr(10)"
        " || '[image sans description]' || chr(10) || chr(10) || '[image: i]' || chr(10) || chr(10) || 'avant après' || chr(10) || chr(10) || 'un deux'",
        "3", "0",
    ),
    "eml_parts_text": (
        ".eml", eml,
        "'**Sujet** : ' || c_mktsegment || chr(10) || '**De** : a@example.org' || chr(10) || '**À** : b@example.org' || chr(10) || chr(10)"
        " || c_name || CASE WHEN c_custkey % 2 = 1 THEN chr(10) || 'fin' ELSE '' END",
        "0", "0",
    ),
}


def _of_files(extension: str, build: Callable[..., bytes]):
    def run(spark, sf):
        found = read_back(read(spark, sf, "customer"), "c_custkey", extension, build, _COLUMNS)
        return found.select("id", "text", "status", "image_count", "page_count")

    return run


def _plain(extension: str):
    def run(spark, sf):
        docs = read(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
        return read_back(docs, "doc_id", extension, None, ("raw",)).select("id", "text", "encoding")

    return run


def _cp1252(spark, sf):
    raw = F.concat(F.encode(F.concat("c_name", F.lit(" ")), "UTF-8"), F.unhex(F.lit("8020E9E8FC20")), F.encode("c_mktsegment", "UTF-8"))
    return read_back(read(spark, sf, "customer").withColumn("raw", raw), "c_custkey", ".txt", None, ("raw",)).select("id", "text", "encoding")


def _tsv(spark, sf):
    raw = F.encode(F.concat(F.lit("nom\tclé\n"), F.col("c_name"), F.lit("\t"), F.col("c_custkey").cast("string"), F.lit("\n")), "UTF-8")
    return read_back(read(spark, sf, "customer").withColumn("raw", raw), "c_custkey", ".tsv", None, ("raw",)).select("id", "text", "status")


def _unknown(spark, sf):
    raw = F.encode(F.col("c_name"), "UTF-8")
    return read_back(read(spark, sf, "customer").withColumn("raw", raw), "c_custkey", ".exe", None, ("raw",)).select("id", "text", "status")


def queries() -> dict[str, Callable]:
    out = {name: _of_files(extension, build) for name, (extension, build, *_) in _FILES.items()}
    out |= {f"{kind}_text": _plain(f".{kind}") for kind in ("md", "yaml", "ini", "log")}
    return out | {"cp1252_text": _cp1252, "tsv_text": _tsv, "unknown_format": _unknown}


def oracle_sql() -> dict[str, str]:
    out = {
        name: f"SELECT c_custkey AS id, {text} AS text, 'ready' AS status, ({images})::INTEGER AS image_count, ({pages})::INTEGER AS page_count FROM customer"
        for name, (_, _, text, images, pages) in _FILES.items()
    }
    out |= {f"{kind}_text": "SELECT doc_id AS id, coalesce(text, '') AS text, 'utf-8' AS encoding FROM documents" for kind in ("md", "yaml", "ini", "log")}
    out["cp1252_text"] = "SELECT c_custkey AS id, c_name || ' € éèü ' || c_mktsegment AS text, 'cp1252' AS encoding FROM customer"
    out["tsv_text"] = "SELECT c_custkey AS id, 'nom | clé' || chr(10) || c_name || ' | ' || c_custkey AS text, 'ready' AS status FROM customer"
    out["unknown_format"] = "SELECT c_custkey AS id, '' AS text, 'ignored' AS status FROM customer"
    return out
