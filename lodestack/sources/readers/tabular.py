"""CSV and TSV, laid out as lines of cells."""

from __future__ import annotations

import csv
import io

from .plain import decoded
from .registry import Extraction, register


def layout(text: str, delimiter: str) -> str:
    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(text), delimiter=delimiter))


@register(".csv", ".tsv")
def read_csv(raw: bytes, extension: str) -> Extraction:
    text, encoding = decoded(raw)
    delimiter = "\t" if extension == ".tsv" else ";" if ";" in text.split("\n", 1)[0] else ","
    return Extraction(text=layout(text, delimiter), encoding=encoding)
