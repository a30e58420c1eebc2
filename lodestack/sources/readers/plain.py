"""Text as it is: encodings, and the formats that need no parsing."""

from __future__ import annotations

from .registry import Extraction, register


def detect_encoding(raw: bytes) -> tuple[str, bytes]:
    """(encoding, bytes to decode): marks first, then strict UTF-8, then Windows-1252, then a detector, then Latin-1."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig", raw[3:]
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16", raw
    for encoding in ("utf-8", "cp1252"):
        try:
            raw.decode(encoding)
            return encoding, raw
        except UnicodeDecodeError:
            continue
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return "latin-1", raw
    best = from_bytes(raw).best()
    return (best.encoding if best else "latin-1"), raw


def decoded(raw: bytes) -> tuple[str, str]:
    encoding, data = detect_encoding(raw)
    return data.decode("utf-8" if encoding == "utf-8-sig" else encoding, errors="replace"), encoding


@register(".txt", ".text", ".log", ".md", ".markdown", ".yaml", ".yml", ".ini", ".cfg")
def read_text(raw: bytes, extension: str) -> Extraction:
    text, encoding = decoded(raw)
    return Extraction(text=text, encoding=encoding)
