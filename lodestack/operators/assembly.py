"""Corpora and reports: ordered blocks of text, written in one file or as a distributed table."""

from __future__ import annotations

import io
import json
import os
import textwrap
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..constants import ERROR, EXTRACTED, VERBATIM_TYPES
from ..functions import columns as C
from ..held import released
from ..i18n import format_number, t
from .prefix import running_sums

#: Places (two numbers each) up to which they are broadcast.
FEW_PLACES = 400_000


def corpus_blocks(files: DataFrame, verbatim=VERBATIM_TYPES, end: str = "\n") -> DataFrame:
    """ord, block: header, empty line, text, empty line, rule; only files that gave text and are not too large."""
    live = files.where(F.col("status").isin(*EXTRACTED))
    header = C.source_header(F.col("tokens_estimated"), F.col("tokens_with_margin"))
    body = C.body(F.coalesce(F.col("text"), F.lit("")), F.col("file_type"), verbatim, end)
    return live.select("ord", F.concat_ws(end, header, F.lit(""), body, F.lit(""), F.lit("---"), F.lit("")).alias("block"))


def preamble(result, now: datetime, end: str = "\n") -> str:
    d = result.decided
    lines = [
        f"# {t('corpus.title')}", "", f"- **{t('corpus.generated')}** : {now:%Y-%m-%d %H:%M:%S}", f"- **{t('corpus.version_label')}** : {__version__}",
        f"- **{t('report.context_limit')}** : {format_number(result.context_limit)} tokens", f"- **{t('report.margin')}** : +{result.margin * 100:.0f} %",
        f"- **{t('report.tokenizer_engine')}** : {t(f'tokenizer.{result.engine_id}')}", f"- **{t('report.total_estimated')}** : {format_number(d.tokens_estimated)}",
        f"- **{t('report.total_with_margin')}** : {format_number(d.tokens_with_margin)}", f"- **{t('corpus.files')}** : {d.n_files}", "", "---", "",
    ]
    return end.join(lines)


def write_ordered(blocks: DataFrame, path: Path, head: bytes, before: bytes) -> int:
    """``head``, then each block (ord, block) with ``before`` in front of it, in one file that the executors write; its size.

    Sums of the blocks' bytes give each block its place, so every task writes where its blocks
    belong, in any order; a repeated task writes the same bytes again.  The file is on a file
    system that driver and executors share, and gets its name when it is whole.
    """
    size = (F.octet_length("block") + len(before)).cast("long")
    places = running_sums(blocks.select("ord", size.alias("size")), [F.col("ord")], F.col("size"), "place").select("ord", "place", "size")
    total = len(head) + (places.agg(F.sum("size")).first()[0] or 0)
    if places.count() <= FEW_PLACES:
        places = F.broadcast(places)
    target, start = f"{path}.{uuid.uuid4().hex}.part", len(head)
    with open(target, "wb") as f:
        f.write(head)
        f.truncate(total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(target, "r+b") as f:
            written = 0
            for batch in batches:
                for place, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    f.seek(start + place)
                    written += f.write(before + block.as_py().encode())
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    try:
        written = blocks.join(places, "ord").select("place", "block").mapInArrow(work, "written long").agg(F.sum("written")).first()[0] or 0
        if start + written != total:
            raise OSError(f"{start + written} of {total} bytes were written to {path}")
        os.replace(target, path)
    finally:
        if os.path.exists(target):
            os.unlink(target)
    return total


def write_markdown(result, path: Path, line_ending: str = "lf", now: datetime | None = None, verbatim=VERBATIM_TYPES) -> None:
    """Line ends of our own are LF or CRLF; those inside headers and texts stay as they are."""
    end = "\r\n" if line_ending == "crlf" else "\n"
    with released():
        write_ordered(corpus_blocks(result.files, verbatim, end), Path(path), preamble(result, now or datetime.now(), end).encode(), end.encode())


def write_distributed(result, folder: str, verbatim=VERBATIM_TYPES) -> None:
    """The blocks as text files in order, written by the executors."""
    corpus_blocks(result.files, verbatim).orderBy("ord").select("block").write.mode("overwrite").text(folder)


def report_rows(files: DataFrame) -> DataFrame:
    """One row per file without its text, with the order and the line of the Markdown table."""
    number = C.format_number
    row = F.concat_ws("", F.lit("| "), F.col("relative_path"), F.lit(" | "), F.col("file_type"), F.lit(" | "), number(F.col("tokens_estimated")), F.lit(" | "), number(F.col("tokens_with_margin")), F.lit(" | "), C.status_label(F.col("status")), F.lit(" |"))
    return files.withColumn("row", row).withColumn("text_length", F.length(F.coalesce(F.col("text"), F.lit("")))).drop("text")


def file_json(rows: DataFrame) -> DataFrame:
    """The projection of a file for the JSON report, as one JSON text per file."""
    names = ("path", "relative_path", "extension", "file_type", "size_bytes", "text_length", "status", "error_message", "image_count", "page_count", "encoding", "chars_per_page", "extra_metadata", "tokens_estimated", "tokens_with_margin")
    none = F.expr("cast(map() as map<string,string>)")
    here = [F.coalesce(F.col(c), none).alias(c) if c == "extra_metadata" else c for c in names if c in rows.columns]
    return rows.select("ord", F.to_json(F.struct(*here), {"ignoreNullFields": "false"}).alias("json"))


def write_json_report(result, path: Path, now: datetime | None = None) -> None:
    d = result.decided
    head = {
        "version": __version__, "timestamp": (now or datetime.now()).isoformat(), "context_limit": result.context_limit, "margin": result.margin, "tokenizer_engine": result.engine_id,
        "total_tokens_estimated": d.tokens_estimated, "total_tokens_with_margin": d.tokens_with_margin, "total_files": d.n_files, "total_ignored": result.n_ignored,
    }
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head, indent=2, ensure_ascii=False)[:-2])
        files = (json.loads(r["json"]) for r in file_json(report_rows(result.files)).orderBy("ord").toLocalIterator())
        ignored = ({"path": r["path"], "reason": r["reason"]} for r in result.ignored.orderBy("path").toLocalIterator())
        for name, items in (("files", files), ("ignored", ignored)):
            f.write(f',\n  "{name}": [')
            first = True
            for x in items:
                f.write(("" if first else ",") + "\n" + textwrap.indent(json.dumps(x, indent=2, ensure_ascii=False), "    "))
                first = False
            f.write("]" if first else "\n  ]")
        f.write("\n}")


def write_markdown_report(result, path: Path, now: datetime | None = None) -> None:
    d = result.decided
    with open(path, "w", encoding="utf-8") as f:
        put = lambda *lines: f.writelines(f"{x}\n" for x in lines)
        put(f"# {t('report.title')}", "", f"- **{t('report.version')}** : {__version__}", f"- **{t('report.date')}** : {now or datetime.now():%Y-%m-%d %H:%M:%S}")
        put(f"- **{t('report.context_limit')}** : {format_number(result.context_limit)}", f"- **{t('report.margin')}** : +{result.margin * 100:.0f} %", f"- **{t('report.tokenizer_engine')}** : {t(f'tokenizer.{result.engine_id}')}")
        put(f"- **{t('report.total_estimated')}** : {format_number(d.tokens_estimated)}", f"- **{t('report.total_with_margin')}** : {format_number(d.tokens_with_margin)}")
        put(f"- **{t('report.files_analyzed')}** : {d.n_files}", f"- **{t('report.files_ignored')}** : {result.n_ignored}", "")
        rows = report_rows(result.files)
        if d.n_files:
            put(f"## {t('report.files_analyzed')}", "", f"| {t('table.file')} | {t('table.type')} | {t('table.text_estimated')} | {t('table.context_margin')} | {t('table.status')} |", "|---|---|---|---|---|")
            put(*(r["row"] for r in rows.select("ord", "row").orderBy("ord").toLocalIterator()), "")
        if result.n_ignored:
            put(f"## {t('report.files_ignored')}", "", f"| {t('table.file')} | {t('report.files_ignored')} |", "|---|---|")
            put(*(f"| {r['name']} | {r['reason']} |" for r in result.ignored.orderBy("path").toLocalIterator()), "")
        errors = [f"- **{r['relative_path']}** : {r['error_message'] or t('error.unknown')}" for r in rows.where(F.col("status") == ERROR).orderBy("ord").select("relative_path", "error_message").toLocalIterator()]
        if errors:
            put(f"## {t('report.errors')}", "", *errors, "")


# --- PDF ---

WIDTH, HEIGHT, SIDE, SIZE, LEAD = 595, 842, 57, 9, 12


def _pdf_text(line: str) -> bytes:
    return line.encode("cp1252", errors="replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


class PdfFile:
    """A4 pages of Helvetica, written as they fill; only the objects' places are kept."""

    def __init__(self, out: io.BufferedIOBase, title: str):
        self.out, self.title, self.places, self.pages, self.lines = out, title, {}, [], []
        self.at = 0
        self._raw(b"%PDF-1.4\n")
        for number, font in ((3, b"Helvetica"), (4, b"Helvetica-Bold")):
            self._object(number, b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % font)
        self.next = 5

    def _raw(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _object(self, number: int, body: bytes) -> None:
        self.places[number] = self.at
        self._raw(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def line(self, text: str, bold: bool = False) -> None:
        for piece in textwrap.wrap(text, 95, replace_whitespace=False, drop_whitespace=True) or [""]:
            if len(self.lines) >= (HEIGHT - 2 * SIDE) // LEAD:
                self.page_break()
            self.lines.append((piece, bold))

    def page_break(self) -> None:
        if not self.lines:
            return
        number = len(self.pages) + 1
        ops = [b"BT /F1 8 Tf %d %d Td (%s) Tj ET" % (SIDE, HEIGHT - 34, _pdf_text(self.title)), b"BT /F1 8 Tf %d 28 Td (%s) Tj ET" % (WIDTH - SIDE - 50, _pdf_text(t("corpus.page", num=number)))]
        for i, (text, bold) in enumerate(self.lines):
            ops.append(b"BT /F%d %d Tf %d %d Td (%s) Tj ET" % (2 if bold else 1, SIZE, SIDE, HEIGHT - SIDE - SIZE - i * LEAD, _pdf_text(text)))
        data = zlib.compress(b"\n".join(ops))
        self._object(self.next, b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data))
        self._object(self.next + 1, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (WIDTH, HEIGHT, self.next))
        self.pages.append(self.next + 1)
        self.next += 2
        self.lines = []

    def close(self) -> None:
        if not self.pages and not self.lines:
            self.lines.append(("", False))
        self.page_break()
        self._object(2, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(self.pages), b" ".join(b"%d 0 R" % p for p in self.pages)))
        self._object(1, b"<< /Type /Catalog /Pages 2 0 R >>")
        start = self.at
        self._raw(b"xref\n0 %d\n0000000000 65535 f \n" % self.next + b"".join(b"%010d 00000 n \n" % self.places[i] for i in range(1, self.next)))
        self._raw(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (self.next, start))


def write_pdf(result, path: Path, now: datetime | None = None) -> None:
    """A preamble, then each file from a new page: header lines bold, a paragraph per line that is not blank."""
    live = result.files.where(F.col("status").isin(*EXTRACTED))
    header = C.source_header(F.col("tokens_estimated"), F.col("tokens_with_margin"))
    rows: Iterable = live.select("ord", header.alias("header"), "text").orderBy("ord").toLocalIterator()
    with open(path, "wb") as f:
        pdf = PdfFile(f, t("corpus.title"))
        for line in preamble(result, now or datetime.now()).split("\n"):
            if line.strip() and line != "---":
                pdf.line(line.lstrip("# ").replace("**", ""), line.startswith("#"))
        for row in rows:
            pdf.page_break()
            for line in row["header"].split("\n"):
                if line != "---":
                    pdf.line(line, True)
            for line in (row["text"] or "").splitlines():
                if line.strip():
                    pdf.line(line)
        pdf.close()
