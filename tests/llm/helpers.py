"""Rows that every operator must take: nulls, empties, ties, repeats, long texts, clashing names."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _gone string, component_id long, copy int, token string, key long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "s")[len(r) - 2 :], 0, "x", 1, 2, "t", 3) if len(r) < 4 else (*r, 0, "x", 1, 2, "t", 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"w{i}" for i in range(60_000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (None, "a text without an id"), (4, "same words here"), (4, "same words here"), (5, LONG), (6, "é ß 日本 😀"), (7, "...")]
