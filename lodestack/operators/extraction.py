"""Reads the inventory's files: one bad file is one error row."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ERROR, FORMATS, LARGE_FILE
from ..functions.decoding import decoded
from ..i18n import language, set_language
from ..schema import EXTRACTED
from ..shipping import ship
from ..sources.readers import registry, safe_read
from ..streaming.progress import Address, reporter
from .prefix import packed, ranges

log = logging.getLogger(__name__)
COLUMNS = [c.split()[0] for c in EXTRACTED.replace("map<string,string>", "map").split(", ")]
#: Bytes, or characters, of content after which a task sends on what it has read.
SENT = 1 << 20
#: Extensions whose text is the file's bytes as they are.
AS_IS = tuple(e for e, kind in FORMATS.items() if kind in ("text", "markdown", "plain"))


def row_of(path: str, relative_path: str, ext: str, size: int, ord: int, raw: bytes | OSError) -> tuple:
    """A row of ``extracted`` from a file's bytes, or from what kept them from being read."""
    if size > LARGE_FILE:
        log.info("large file: %s", path)
    found = registry.failed(raw) if isinstance(raw, OSError) else safe_read(raw, ext)
    size = size if isinstance(raw, OSError) else len(raw)
    kind = found.file_type or ext.lstrip(".")
    status = found.status if found.status != "ready" else None
    return (path, relative_path, ext.lstrip("."), kind, size, found.text, status, found.error_message, found.image_count, found.page_count, found.encoding, found.chars_per_page, None, ord)


def read_one(path: str, relative_path: str, ext: str, size: int, ord: int) -> tuple:
    try:
        with open(path, "rb") as f:
            raw: bytes | OSError = f.read()
    except OSError as exc:
        raw = exc
    return row_of(path, relative_path, ext, size, ord, raw)


def extract(inventory: DataFrame, done: Address | None = None, status: Callable[[tuple], str] | None = None) -> DataFrame:
    """The table ``extracted``; extract_status is null where the text was read.

    Files are dealt out by their sizes, in order.  ``done`` is told of each file as it has
    been read, with what ``status`` makes of its row.
    """
    lang, readers = language(), registry.snapshot()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        set_language(lang)
        registry.install(readers)
        with reporter(done) as tell:
            for batch in batches:
                held, size = [], 0
                for row in batch.itertuples(index=False):
                    found = read_one(row.path, row.relative_path, row.ext, row.size_bytes, row.ord)
                    tell(row.path, status(found) if status else "")
                    held.append(found)
                    size += len(found[5] or "")
                    # Small files share a frame; texts can be megabytes each.
                    if size >= SENT:
                        yield pd.DataFrame(held, columns=COLUMNS)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=COLUMNS)

    ship(inventory.sparkSession)
    narrow = inventory.select("path", "relative_path", "ext", "size_bytes", "ord")
    return packed(narrow, "size_bytes", [F.col("ord"), F.col("path")]).mapInPandas(work, EXTRACTED)


def extract_bytes(files: DataFrame) -> DataFrame:
    """``extracted`` from rows that bring their bytes: path, relative_path, ext, size_bytes, ord, raw.

    Text formats are decoded by expressions; the others, and the few texts that these leave
    open, go to their readers.  A reader registered in place of the text reader is used for all.
    """
    lang, readers = language(), registry.snapshot()
    own = [e for e in AS_IS if readers.get(e) and readers[e][0][2].__module__ == "lodestack.sources.readers.plain"]
    plain = F.col("ext").isin(*own)
    ext = F.regexp_replace("ext", "^\\.", "")
    texts = decoded(files.where(plain).withColumn("size_bytes", F.octet_length(F.coalesce("raw", F.lit(b""))).cast("long")))
    none = lambda kind: F.lit(None).cast(kind)
    texts = texts.select(
        "path", "relative_path", ext.alias("extension"), ext.alias("file_type"), "size_bytes", "text", none("string").alias("extract_status"), none("string").alias("error_message"),
        F.lit(0).alias("image_count"), F.lit(0).alias("page_count"), "encoding", F.array().cast("array<int>").alias("chars_per_page"), none("map<string,string>").alias("extra_metadata"), "ord",
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        set_language(lang)
        registry.install(readers)
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame([row_of(row.path, row.relative_path, row.ext, row.size_bytes, row.ord, bytes(row.raw or b""))], columns=COLUMNS)

    ship(files.sparkSession)
    others = files.where(~plain).select("path", "relative_path", "ext", "size_bytes", "ord", "raw").mapInPandas(work, EXTRACTED)
    return texts.unionByName(others)


def read_ranges(inventory: DataFrame, target: int, shared: bool = False) -> DataFrame:
    """path, part, offset, raw: the files' bytes in ranges of ``target`` at most, dealt out so that no task reads more than twice that.

    That is a task for each ``target`` bytes of the input.  Where ranges are small, ``shared`` packs them into
    tasks as whole files are, so that the number of tasks does not follow that of the ranges.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = 0, 0
            raw: list[bytes] = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                with open(path, "rb") as f:
                    f.seek(offset)
                    raw.append(f.read(length))
                size += length
                if size >= SENT or at + len(raw) == batch.num_rows:
                    own = batch.slice(at, len(raw))
                    yield pa.RecordBatch.from_arrays([own.column(c) for c in ("path", "part", "offset")] + [pa.array(raw, pa.binary())], names=["path", "part", "offset", "raw"])
                    at, size, raw = at + len(raw), 0, []

    rows = ranges(inventory.select("path", "size_bytes"), "size_bytes", target)
    return packed(rows, "length", [F.col("path"), F.col("part")], None if shared else target).mapInArrow(work, "path string, part int, offset long, raw binary")


def is_failed(status: str = "extract_status"):
    return F.coalesce(F.col(status) == ERROR, F.lit(False))
