"""Bytes to text as expressions: marks, UTF-8, UTF-16 and Windows-1252 without Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Windows-1252 where it differs from Latin-1, as its own codec says; bytes that it leaves undefined have no entry.
_HIGH = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_UNDEFINED = "[\\x81\\x8D\\x8F\\x90\\x9D]"
# Pairs of bytes (as Latin-1 characters) in which surrogates stand in twos; possessive, so that long texts take no stack.
_PAIRED_BE = r"(?s)\A(?:[^\xD8-\xDF].|[\xD8-\xDB].[\xDC-\xDF].)*+\z"
_PAIRED_LE = r"(?s)\A(?:.[^\xD8-\xDF]|.[\xD8-\xDB].[\xDC-\xDF])*+\z"


def _begins(raw: Column, mark: str) -> Column:
    return F.substring(raw, 1, len(mark) // 2) == F.unhex(F.lit(mark))


def encoding_of(raw: Column) -> Column:
    """utf-8-sig, utf-16, utf-8 or cp1252, as the text reader tells them; null for bytes that only the reader can tell."""
    latin = F.decode(raw, "ISO-8859-1")
    fits = F.when(_begins(raw, "FEFF"), F.rlike(latin, F.lit(_PAIRED_BE))).otherwise(F.rlike(latin, F.lit(_PAIRED_LE)))
    return (
        F.when(_begins(raw, "EFBBBF"), "utf-8-sig")
        .when(_begins(raw, "FFFE") | _begins(raw, "FEFF"), F.when(fits, "utf-16"))
        .when(F.is_valid_utf8(raw.cast("string")), "utf-8")
        .when(~F.rlike(latin, F.lit(_UNDEFINED)), "cp1252")
    )


def text_in(raw: Column, encoding: Column) -> Column:
    """The bytes as text in one of the encodings of ``encoding_of``."""
    rest = F.substring(raw, 4, 2**31 - 1).cast("string")
    return (
        F.when(encoding == "utf-8-sig", F.make_valid_utf8(rest))
        .when(encoding == "utf-16", F.decode(raw, "UTF-16"))
        .when(encoding == "utf-8", raw.cast("string"))
        .when(encoding == "cp1252", F.translate(F.decode(raw, "ISO-8859-1"), "".join(_HIGH), "".join(_HIGH.values())))
    )


def decoded(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with the columns encoding and text in place of ``raw``.

    Rows that the expressions leave open (broken UTF-16, bytes that Windows-1252 does not
    define) go to the text reader; without such rows there is no Python in the plan.  Null
    bytes count as none.
    """
    bytes_ = F.coalesce(F.col(raw).cast("binary"), F.lit(b""))
    told = df.withColumn(raw, bytes_).withColumn("encoding", encoding_of(F.col(raw)))
    others = [c for c in df.columns if c != raw]
    known = told.where(F.col("encoding").isNotNull()).select(*(F.col(f"`{c}`") for c in others), "encoding", text_in(F.col(raw), F.col("encoding")).alias("text"))
    left = told.where(F.col("encoding").isNull()).drop("encoding")
    if not left.limit(1).count():
        return known

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources.readers.plain import decoded as read

        for batch in batches:
            found = [read(bytes(x)) for x in batch[raw]]
            yield batch.drop(columns=[raw]).assign(encoding=[e for _, e in found], text=[t for t, _ in found])

    ship(df.sparkSession)
    return known.unionByName(left.select(*(F.col(f"`{c}`") for c in others), raw).mapInPandas(work, known.schema))
