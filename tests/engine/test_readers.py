"""Every format, and the isolation of errors."""

import pytest

from lodestack.constants import EXTENSIONS
from lodestack.sources.readers import registry, safe_read, supported_extensions
from lodestack.sources.readers.html import blocks, body_of, parse
from lodestack.sources.readers.plain import detect_encoding

from . import builders


def text(raw, ext):
    found = safe_read(raw if isinstance(raw, bytes) else raw.encode(), ext)
    assert found.status == "ready", found.error_message
    return found.text


def test_every_extension_has_a_reader():
    assert tuple(supported_extensions()) == EXTENSIONS and len(EXTENSIONS) == 26


@pytest.mark.parametrize(("raw", "want"), [("é".encode(), "utf-8"), (b"", "utf-8"), (b"\xef\xbb\xbfa", "utf-8-sig"), ("é".encode("utf-16"), "utf-16"), ("é€".encode("cp1252"), "cp1252")])
def test_encodings(raw, want):
    assert detect_encoding(raw)[0] == want


def test_text_formats():
    assert text("\ufeffa\r\nb", ".txt") == "a\r\nb"
    assert text("é€".encode("cp1252"), ".log") == "é€"
    assert text("# x\n```", ".md") == "# x\n```" and text("k: v", ".yaml") == "k: v"
    assert text("a,b\n\n1,\"2,3\"", ".csv") == "a | b\n\n1 | 2,3"
    assert text("a;b\n1;2,5", ".csv") == "a | b\n1 | 2,5" and text("a\tb;c", ".tsv") == "a | b;c"
    assert text('{"b":1,"b":2,"é":[1]}', ".json") == '{\n  "b": 2,\n  "é": [\n    1\n  ]\n}'
    assert text("<?xml version='1.0'?><!-- c --><r><i>t</i></r>", ".xml") == "<r>\n  <i>t</i>\n</r>"


def test_html_blocks():
    html = """<html><head><title>no</title><style>x{}</style></head><body>bare<!-- note --><h2> A <b>b</b></h2><p>one <b>two</b><img alt=" i ">
    <p>next<div>d<h1>in</h1><ul><li>q</ul></div><ul><li>a<li>b <i>c</i></ul><ol><li>x</li></ol><table><tr><th>h<th>k<tr><td>1<td><img></table><nav><a>l</a> <a>m</a></nav><img><script>no</script></body></html>"""
    parts, images = blocks(body_of(parse(html.replace("<script>no</script>", ""))))
    assert parts == ["bare", "note", "## Ab", "[image: i]", "one two", "next", "d in q", "- a\n- bc", "1. x", "| h | k |\n| --- | --- |\n| 1 |  |", "lm", "[image sans description]"]
    assert images == 2
    assert "note" not in blocks(body_of(parse(html)), keep_comments=False)[0]
    assert text(html, ".htm").count("no\n") == 0 and "x{}" not in text(html, ".html")
    assert safe_read(b"<br><br>", ".html").text == ""


def test_rtf():
    raw = r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0 Un \b gras\b0  \'e9\par Deux\tab \u8364?\{x\}{\pict 00ff}\u-10179?\u-8704?}"
    assert text(raw, ".rtf") == "Un gras é\nDeux\t€{x}\U0001f600"
    assert safe_read(raw.encode(), ".rtf").encoding == "latin-1"


def test_office_formats():
    found = safe_read(builders.docx(), ".docx")
    assert found.text == "Titre\n\nun\tdeux\nlien\n\na | b\n\nc | c\n\n[en-tête] haut\n\n[pied de page] bas\n\n[notes de bas de page]\nnote\n\n[zones de texte]\nboîte"
    assert (found.image_count, found.file_type) == (1, "docx")
    found = safe_read(builders.pptx(), ".pptx")
    assert found.text == "## Diapo 1\n\nTitre\n\ncorps\n\nx | y\n\n[Notes] dire\n\n---\n\n## Diapo 2\n\n[[DIAPO 2: aucun texte extractible]]"
    assert (found.page_count, found.image_count) == (2, 1)
    found = safe_read(builders.xlsx(), ".xlsx")
    assert found.text == "### Feuille : Un\n\nnom |  | riche\n3 | 2.5 | 2024-01-01 00:00:00\nTrue |  | \n\n### Feuille : Deux\n\n[Feuille vide]"
    assert found.page_count == 2
    found = safe_read(builders.odt(), ".odt")
    assert found.text == "Titre\nundeux\na | b\n- i" and found.image_count == 1


def test_mail():
    eml = "Subject: =?utf-8?q?Caf=C3=A9?=\nFrom: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=X\n\n--X\nContent-Type: text/html\n\n<p>html</p>\n--X\nContent-Type: text/plain\n\nplain\n--X--\n"
    assert text(eml, ".eml") == "**Sujet** : Café\n**De** : a@b.c\n\nplain"
    assert text("From: a@b.c\nContent-Type: text/html\n\n<p>x<script>n</script></p>y", ".eml") == "**De** : a@b.c\n\nx\ny"
    assert text("To: b\n\nbody\n", ".eml") == "**À** : b\n\nbody\n"
    mht = "MIME-Version: 1.0\nContent-Type: multipart/related; boundary=X\n\n--X\nContent-Type: text/html\n\n<h1>T</h1><p>a <b>b</b></p>\n--X\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\niVBORw0=\n--X--\n"
    found = safe_read(mht.encode(), ".mht")
    assert found.text == "T\na\nb" and found.image_count == 1


def test_pdf():
    found = safe_read(builders.pdf((rb"(Bon\152our \(x\)) Tj 0 -14 Td [(A) -300 (B) 10 (C)] TJ", b"")), ".pdf")
    assert found.text == "Bonjour (x)\nA BC\n\n[[PAGE 2: aucun texte extractible]]"
    assert (found.page_count, found.image_count, found.chars_per_page) == (2, 1, [16, 0])
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"
    mapped = builders.pdf((b"<000100020003> Tj",), font=font, extra={5: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)}.items())
    assert safe_read(mapped, ".pdf").text == "éab"
    found = safe_read(builders.pdf(encrypted=True), ".pdf")
    assert found.status == "error" and "chiffré" in found.error_message


@pytest.mark.parametrize(("raw", "ext"), [(b"{", ".json"), (b"<a>", ".xml"), (b"x", ".docx"), (b"x", ".xlsx"), (b"x", ".pptx"), (b"x", ".odt"), (b"x", ".pdf"), (builders.zipped({"a": "b"}), ".odt")])
def test_broken_files_are_error_rows(raw, ext):
    found = safe_read(raw, ext)
    assert found.status == "error" and found.error_message and not found.text


def test_unknown_extension_is_ignored():
    assert safe_read(b"x", ".exe").status == "ignored"


def test_registry_priorities(monkeypatch):
    monkeypatch.setattr(registry, "_readers", {k: list(v) for k, v in registry._readers.items()})
    low, late = (lambda raw, e: registry.Extraction(text="low")), (lambda raw, e: registry.Extraction(text="late"))
    registry.register(".new", priority=1.0)(late)
    registry.register(".NEW")(low)
    registry.register(".new")(late)
    assert safe_read(b"", ".new").text == "low"

    @registry.register(".bad")
    def bad(raw, ext):
        raise ValueError

    assert safe_read(b"", ".bad").error_message == "Erreur inconnue"
